"""Exact k nearest neighbours of every row of one (minority) class.

Rows fall into cells around pivots, which form a tree of two levels: a row goes to the nearest
of about the square root of all pivots, then to the nearest cell below it. A query first
searches its own cell; the distance found there and the triangle inequality rule out every
node and every cell whose ball cannot hold a nearer row, and only the others are searched. The
result is exact. One task compares one block of a cell's queries with one block of
candidates and emits k candidates per query. Exact copies are folded first, so a vector
shared by many rows is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.operators.encode import dictionary_join
from rareflow.session import materialize

BLOCK_CELLS = 4_000_000       # numbers per block: rows x width
MAX_CELLS = 65_536            # cells of the tree; larger ones are cut into blocks
PIVOT_NUMBERS = 8_000_000     # numbers in all pivots together (64 MB), which every task holds
TILE_CELLS = 8_000_000        # distances held at once inside a task


def nearest_in_block(queries: np.ndarray, candidates: np.ndarray, k: int
                     ) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (candidate positions, squared distances) of the k nearest.

    A matrix product narrows the candidates with a margin above its rounding
    error; the survivors are measured directly. Ties at the end are all kept.
    """
    q2, c2 = (queries**2).sum(axis=1), (candidates**2).sum(axis=1)
    k = min(k, len(candidates))
    out = []
    tile = max(1, TILE_CELLS // max(1, len(candidates)))
    for start in range(0, len(queries), tile):
        q = queries[start:start + tile]
        rough = q2[start:start + tile, None] + c2[None, :] - 2.0 * (q @ candidates.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        margin = 1e-9 * (q2[start:start + tile] + c2.max())
        for i in range(len(q)):
            near = np.flatnonzero(rough[i] <= kth[i] + 2 * margin[i])
            exact = ((candidates[near] - q[i]) ** 2).sum(axis=1)
            limit = np.partition(exact, k - 1)[k - 1]
            kept = exact <= limit
            out.append((near[kept], exact[kept]))
    return out


def k_nearest(df: DataFrame, key: str, features: str, k: int, block_cells: int = BLOCK_CELLS,
              asked: Column | None = None) -> DataFrame:
    """(key, neighbours: array<struct<distance, id>>) with the k nearest other rows.

    Order: distance, then id. ``key`` must be unique. With ``asked`` only the rows it marks
    look for neighbours, among all rows.
    """
    if asked is not None:
        asking = df.where(asked).select(F.col(key).alias("id"), F.col(features).alias("v"))
    rows = df.select(F.col(key).alias("id"), F.col(features).alias("v")).withColumn(
        "print", F.md5(F.col("v").cast("string").cast("binary")))
    # the k + 1 smallest ids of each distinct vector; the limit is applied before
    # the shuffle, so copies do not pile up
    rank = F.row_number().over(Window.partitionBy("print").orderBy("id"))
    first = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    points = first.groupBy("print").agg(F.first("v").alias("v"),
                                        F.sort_array(F.collect_list("id")).alias("ids"))
    if asked is None:
        points = points.withColumn("asks", F.lit(True))
    else:
        rows = asking.withColumn("print", F.md5(F.col("v").cast("string").cast("binary")))
        wanted = rows.select("print").distinct().withColumn("asks", F.lit(True))
        points = points.join(wanted, "print", "left").withColumn(
            "asks", F.coalesce("asks", F.lit(False)))
    points = materialize(points, "points")
    id_type = points.schema["ids"].dataType.elementType.simpleString()
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return rows.select(F.col("id").alias(key)).withColumn(
            "neighbours", F.lit(None).cast(f"array<struct<distance:double,id:{id_type}>>"))
    near_type = f"array<struct<distance:double,id:{id_type}>>"
    partial = _search(points, size["n"] * size["width"], k, block_cells, near_type, id_type)
    # at most k + 1 entries per vector and block searched
    merged = partial.groupBy("print").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    merged = materialize(merged, "neighbours")
    found = dictionary_join(rows.select("id", "print"),
                            merged.withColumnRenamed("print", "value"), "print", "near", "near",
                            size["n"] * (k + 1) * 32)
    mine = F.filter("near", lambda x: x["id"] != F.col("id"))
    return found.select(F.col("id").alias(key), F.slice(mine, 1, k).alias("neighbours"))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2.0 * (v @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def visited_cells(v: np.ndarray, limit: np.ndarray, pivots: np.ndarray, radius: np.ndarray
                  ) -> np.ndarray:
    """(queries x cells): whether a row within ``limit`` of the query may lie in the cell."""
    away = _distances(v, pivots)
    slack = 1e-6 * (1.0 + away)          # of distances computed by a matrix product
    return away - radius <= limit[:, None] + slack


class PivotTree:
    """Cells below the nodes of one upper level, with the ball that holds each one's rows."""

    def __init__(self, pivots: np.ndarray):
        tops = pivots[:max(1, int(np.ceil(np.sqrt(len(pivots)))))]
        below = _distances(pivots, tops).argmin(axis=1)
        used, below = np.unique(below, return_inverse=True)
        self.tops = tops[used]
        order = np.argsort(below, kind="stable")
        self.cells = pivots[order]
        self.first = np.searchsorted(below[order], np.arange(len(self.tops) + 1))
        self.radius = np.full(len(self.cells), -np.inf)
        self.top_radius = np.full(len(self.tops), -np.inf)
        self.rows = np.zeros(len(self.cells), "int64")

    def below(self, top: int) -> slice:
        return slice(self.first[top], self.first[top + 1])

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row its cell, its distance to the cell's pivot and to the node above."""
        away = _distances(v, self.tops)
        top = away.argmin(axis=1)
        cell, near = np.zeros(len(v), "int64"), np.zeros(len(v))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            inside = _distances(v[mine], self.cells[self.below(t)])
            best = inside.argmin(axis=1)
            cell[mine], near[mine] = self.first[t] + best, inside[np.arange(len(mine)), best]
        return cell, near, away[np.arange(len(v)), top]

    def measure(self, cell: np.ndarray, radius: np.ndarray, top_radius: np.ndarray,
                rows: np.ndarray) -> None:
        """Balls and sizes of the cells that hold rows."""
        self.radius[cell], self.rows[cell] = radius, rows
        np.maximum.at(self.top_radius, np.searchsorted(self.first, cell, "right") - 1, top_radius)

    def reach(self, v: np.ndarray, need: int) -> np.ndarray:
        """Per row a distance within which ``need`` rows of the tree lie; infinite if it has fewer."""
        totals = np.add.reduceat(self.rows, self.first[:-1])
        limit = _within(_distances(v, self.tops), self.top_radius, totals, need)
        for t in range(len(self.tops)):
            # the cells of one node may hold enough rows nearer than whole nodes do
            low = _within(_distances(v, self.cells[self.below(t)]), self.radius[self.below(t)],
                          self.rows[self.below(t)], need)
            limit = np.minimum(limit, low)
        return limit

    def visited(self, v: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs where a row within ``limit`` may lie in the cell."""
        rows, cells = [np.empty(0, "int64")], [np.empty(0, "int64")]
        open_tops = visited_cells(v, limit, self.tops, self.top_radius)
        for t in np.flatnonzero(open_tops.any(axis=0)):
            asking = np.flatnonzero(open_tops[:, t])
            row, cell = np.nonzero(visited_cells(v[asking], limit[asking], self.cells[self.below(t)],
                                                 self.radius[self.below(t)]))
            rows.append(asking[row])
            cells.append(self.first[t] + cell)
        row, cell = np.concatenate(rows), np.concatenate(cells)
        held = self.rows[cell] > 0
        return row[held], cell[held]


def _within(away: np.ndarray, radius: np.ndarray, rows: np.ndarray, need: int) -> np.ndarray:
    """Per query the smallest far edge of balls by which ``need`` rows are inside them."""
    far = np.where(rows > 0, away + radius + 1e-6 * (1.0 + away), np.inf)
    order = far.argsort(axis=1)
    enough = rows[order].cumsum(axis=1) >= need
    edge = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(axis=1)]
    return np.where(enough.any(axis=1), edge, np.inf)


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    """The first ``count`` vectors in hash order."""
    v = points.select(F.col("v").cast("array<double>").alias("v"), "print").orderBy("print") \
        .limit(count).select("v").toArrow()["v"].combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1)


def _search(points: DataFrame, numbers: int, k: int, block_cells: int, near_type: str,
            id_type: str) -> DataFrame:
    """(print, near): the best k + 1 rows of every block a query has to search."""
    width = max(1, numbers // max(1, points.count()))
    count = min(MAX_CELLS, max(1, PIVOT_NUMBERS // width), max(1, -(-numbers // block_cells)))
    tree = PivotTree(_pivots(points, count))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cell, away, above = tree.place(np.array(batch["v"].tolist(), "float64"))
            yield pd.DataFrame({"print": batch["print"], "v": batch["v"], "ids": batch["ids"],
                                "asks": batch["asks"], "cell": cell, "away": away, "above": above})

    placed = materialize(points.select("print", "v", "ids", "asks").mapInPandas(
        assign, f"print string, v array<double>, ids array<{id_type}>, asks boolean, cell int, "
                "away double, above double"), "cells")
    # a row per cell, MAX_CELLS at most
    sizes = placed.groupBy("cell").agg(F.max("away").alias("r"), F.max("above").alias("top"),
                                       F.count("*").alias("n")).toPandas()
    tree.measure(*[sizes[c].to_numpy() for c in ("cell", "r", "top", "n")])
    sizes["blocks"] = -(-sizes["n"] * width // block_cells)
    blocks = F.broadcast(points.sparkSession.createDataFrame(
        sizes[["cell", "blocks"]], "cell int, blocks int"))
    mine = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    placed = placed.join(blocks, "cell").withColumn("block", mine)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"print": [], "near": []})
        q = np.stack(left["v"].to_numpy()).astype("float64")
        c = np.stack(right["c_v"].to_numpy()).astype("float64")
        ids = right["ids"].to_numpy()
        near = []
        for positions, squares in nearest_in_block(q, c, k + 1):
            found = [(float(np.sqrt(s)), i) for p, s in zip(positions, squares) for i in ids[p]]
            near.append([{"distance": d, "id": i} for d, i in sorted(found)[:k + 1]])
        return pd.DataFrame({"print": left["print"].to_numpy(), "near": near})

    def meet(asked: DataFrame) -> DataFrame:
        """``asked``: print, v, home and home_block of the query, cell to be searched."""
        asked = asked.join(blocks, "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["home", "home_block", "cell", "block"]
        met = asked.select(*key).distinct().withColumnsRenamed({c: f"c_{c}" for c in key})
        candidates = placed.select(F.col("cell").alias("c_cell"), F.col("block").alias("c_block"),
                                   F.col("v").alias("c_v"), "ids").join(met, ["c_cell", "c_block"])
        return (asked.groupBy(*key).cogroup(candidates.groupBy(*[f"c_{c}" for c in key]))
                .applyInPandas(compare, f"print string, near {near_type}"))

    own = placed.where("asks").select("print", "v", F.col("cell").alias("home"),
                                      F.col("block").alias("home_block"), "cell")
    first = materialize(meet(own), "home-cells")
    limit = (first.groupBy("print").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))),
                                                1, k + 1).alias("near"))
             .select("print", F.when(F.size("near") > k, F.get("near", F.lit(k))["distance"])
                     .otherwise(F.lit(float("inf"))).alias("limit")))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v, within = np.array(batch["v"].tolist(), "float64"), batch["limit"].to_numpy(float)
            lone = np.isinf(within)      # its cell holds too few rows to set a limit
            if lone.any():
                within = within.copy()
                within[lone] = tree.reach(v[lone], k + 1)
            row, cell = tree.visited(v, within)
            away = cell != batch["home"].to_numpy()[row]
            out = batch[["print", "v", "home", "home_block"]].iloc[row[away]].reset_index(drop=True)
            out["cell"] = cell[away]
            yield out

    more = own.join(limit, "print").select("print", "v", "home", "home_block", "limit").mapInPandas(
        others, "print string, v array<double>, home int, home_block int, cell int")
    return first.unionByName(meet(more))
