"""Nearest neighbours by cosine with vantage-point trees.

On unit vectors the chord length is a metric that falls as the cosine rises. Vantage points of a
bounded sample cut space into shards, and every shard has a vantage-point tree of its own.
A query first searches the shard it falls into; the distance found there lets the triangle
inequality rule out most other shards and, in a shard, most branches. ``factor`` scales the
ball around the query that must be searched: one keeps the search exact, less prunes more.

Equal vectors are one point with its smallest ids, as many as can be asked for. Cosines that agree to
about twelve digits tie; points are cut in the order of cosine and smallest id, so of any number
of tied points those with the smallest ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.llm.common import Shelf

SLACK = 4e-6                 # of distances: what tied cosines may differ by at the edge of a ball
LEVELS = 0.98765432109e12    # of cosines; not decimal, so that simple fractions lie inside a level
NO_LEVEL = -(1 << 62)


@dataclass(frozen=True)
class Tree:
    """Vantage points, radii and children; children below zero are leaves."""

    points: np.ndarray
    radii: np.ndarray
    inner: np.ndarray
    outer: np.ndarray


def grow(vectors: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
    """Split at median distances from a far point until ``leaf`` rows are left.

    Rows at one distance stay together, so leaves may be larger if points coincide.
    """
    points, radii, inner, outer, leaves = [], [], [], [], []

    def build(rows: np.ndarray, away: int) -> int:
        if len(rows) > leaf:
            # a point far from another one makes the distances differ
            far = rows[int(np.argmin(vectors[rows] @ vectors[rows[away % len(rows)]]))]
            d = chord(vectors[rows] @ vectors[far])
            radius = float(np.median(d))
            near = d <= radius
            if not near.all():
                node = len(points)
                points.append(vectors[far])
                radii.append(radius)
                inner.append(0)
                outer.append(0)
                inner[node] = build(rows[near], away + 1)
                outer[node] = build(rows[~near], away + 1)
                return node
        leaves.append(rows)
        return -len(leaves)

    build(np.arange(len(vectors)), 0)
    if not points:
        return Tree(np.empty((0, vectors.shape[1])), *(np.empty(0),) * 3), leaves
    return Tree(np.array(points), np.array(radii), np.array(inner), np.array(outer)), leaves


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def level(cosine: np.ndarray) -> np.ndarray:
    """Cosines as whole numbers; those that differ by rounding only are equal."""
    return np.floor(cosine * LEVELS + 0.381966).astype(np.int64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest part near one: squares stay finite, and
    cosines as they are."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def home(tree: Tree, units: np.ndarray) -> np.ndarray:
    """The leaf each row falls into."""
    out = np.zeros(len(units), np.int64)
    if not len(tree.points):
        return out
    at = np.zeros(len(units), np.int64)
    live = np.arange(len(units))
    while len(live):
        node = at[live]
        d = chord(np.einsum("ij,ij->i", units[live], tree.points[node]))
        at[live] = np.where(d <= tree.radii[node], tree.inner[node], tree.outer[node])
        live = live[at[live] >= 0]
    return -at - 1


def reached(tree: Tree, query: np.ndarray, ball: float) -> list[int]:
    """Leaves that the ball around a query may touch."""
    if not len(tree.points):
        return [0]
    out, work = [], [0]
    while work:
        node = work.pop()
        if node < 0:
            out.append(-node - 1)
            continue
        d = float(chord(query @ tree.points[node]))
        if d - ball <= tree.radii[node] + SLACK:
            work.append(int(tree.inner[node]))
        if d + ball >= tree.radii[node] - SLACK:
            work.append(int(tree.outer[node]))
    return out


class Searcher:
    """One shard's tree and the best rows per query so far; of tied rows the first ones."""

    def __init__(self, units: np.ndarray, leaf: int, count: int, factor: float):
        self.units, self.count, self.factor = units, count, factor
        self.tree, self.leaves = grow(units, leaf)

    def search(self, queries: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, levels) per query, nearest first; unfilled places are row -1."""
        self.queries, self.limit = queries, ball.copy()
        self.rows = np.full((len(queries), self.count), -1, np.int64)
        self.level = np.full((len(queries), self.count), NO_LEVEL, np.int64)
        self._visit(0 if len(self.tree.points) else -1, np.arange(len(queries)))
        return self.rows, self.level

    def _visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if node < 0:
            self._leaf(self.leaves[-node - 1], who)
            return
        tree = self.tree
        d = chord(self.queries[who] @ tree.points[node])
        radius, inside = tree.radii[node], d <= tree.radii[node]
        inner, outer = int(tree.inner[node]), int(tree.outer[node])
        self._visit(inner, who[inside])
        self._visit(outer, who[~inside])
        last = self.level[who, -1]
        last = np.where(last == NO_LEVEL, np.inf, chord(last / LEVELS))
        ball = self.factor * np.minimum(last, self.limit[who]) + SLACK
        self._visit(outer, who[inside & (d + ball >= radius)])
        self._visit(inner, who[~inside & (d - ball <= radius)])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        for start in range(0, len(rows), 4096):
            part = rows[start:start + 4096]
            for first in range(0, len(who), 1024):
                some = who[first:first + 1024]
                found = level(self.queries[some] @ self.units[part].T)
                ids = np.broadcast_to(part, found.shape)
                if len(part) > self.count:
                    near = np.argpartition(np.arange(len(part)) - found * len(part),
                                           self.count - 1, axis=1)[:, :self.count]
                    found, ids = (np.take_along_axis(x, near, 1) for x in (found, ids))
                both = np.hstack([self.level[some], found])
                ids = np.hstack([self.rows[some], ids])
                order = np.lexsort((ids, -both), axis=1)[:, :self.count]
                self.level[some] = np.take_along_axis(both, order, 1)
                self.rows[some] = np.take_along_axis(ids, order, 1)


@dataclass(frozen=True)
class NearestNeighbours:
    """The ``count`` nearest candidates of each query by cosine, ties to the smaller id.

    Cosines that agree to about twelve digits are ties, as of scaled copies of a vector.
    Vectors that are null, zero or hold null or non-finite parts, and rows without an id,
    take no part. Vectors of different lengths are searched apart. Rows that repeat an id and a
    vector count once. A query never finds its own id; with fewer candidates all are
    returned. Empty tables give an empty result.
    """

    count: int = 5
    factor: float = 0.3          # 1: exact
    shard_rows: int = 8192       # aimed at; vectors at one point stay together
    sample_rows: int = 20_000    # vectors the shards' vantage points are fitted on
    leaf: int = 512
    query_block: int = 16_384    # queries that meet a shard in one task

    def search(self, vectors: DataFrame, is_query: Column, id_column: str = "vec_id",
               vector_column: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``id``."""
        spark = vectors.sparkSession
        shelf = Shelf(spark)
        v = F.col(vector_column).cast("array<double>")
        rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
            F.col("id").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
        # a negative zero equals zero, in groups too
        rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()
        few = Window.partitionBy("v").orderBy("id")
        points = (rows.withColumn("place", F.row_number().over(few))
                  .where(F.col("place") <= self.count + 1)
                  .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
        points = shelf.keep(points.withColumn("dim", F.size("v")), "points")
        queries = rows.where(is_query).withColumn("dim", F.size("v"))
        found = None
        for row in points.select("dim").distinct().orderBy("dim").collect():
            part = self._search(shelf, points.where(F.col("dim") == row["dim"]),
                                queries.where(F.col("dim") == row["dim"]))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.col("level").desc(), "vec_id")
        one = found.groupBy("query_id", "vec_id").agg(
            F.max("level").alias("level"), F.max("score").alias("score"))
        return shelf.finish(one.withColumn("rank", F.row_number().over(best))
                            .where(F.col("rank") <= self.count)
                            .select("query_id", "rank", "vec_id", "score"), "nearest")

    def _search(self, shelf: Shelf, points: DataFrame, queries: DataFrame) -> DataFrame:
        total = points.count()
        order = F.xxhash64("v")
        sample = points.select("v").orderBy(order).limit(self.sample_rows).collect()
        sample = unit(np.array([r["v"] for r in sample], float))
        shards = max(1, min(-(-total // self.shard_rows), len(sample) // 16))
        tree, _ = grow(sample, max(1, -(-len(sample) // shards)))
        placed = shelf.keep(points.mapInPandas(
            lambda batches: _homes(batches, tree), "shard long, v array<double>, ids array<long>"),
            "placed")
        asked = shelf.keep(queries.select("id", "v").mapInPandas(
            lambda batches: _asked(batches, tree), "shard long, id long, v array<double>"), "asked")
        blocks = max(1, -(-asked.count() // self.query_block))
        near = shelf.keep(self._meet(placed, asked.withColumn(
            "ball", F.lit(float("inf"))), blocks), "near")
        # the distance to the last of a query's hits bounds what other shards must offer
        rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        balls = (near.withColumn("n", F.row_number().over(rank)).where(F.col("n") == self.count)
                 .select(F.col("query_id").alias("id"), F.col("distance").alias("ball")))
        factor = self.factor
        others = asked.join(balls, "id", "left").withColumn(
            "ball", F.coalesce("ball", F.lit(float("inf")))).mapInPandas(
            lambda batches: _others(batches, tree, factor),
            "shard long, id long, v array<double>, ball double")
        return near.unionByName(self._meet(placed, others, blocks)).select(
            "query_id", "vec_id", "level", "score")

    def _meet(self, placed: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
        """Queries searched in the shards they were sent to."""
        count, factor, leaf = self.count, self.factor, self.leaf
        names = ["query_id", "vec_id", "distance", "level", "score"]

        def run(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(asked):
                return pd.DataFrame({c: [] for c in names})
            # by smallest id: neither ties nor trees depend on the order of arrival
            held = sorted(zip((list(x) for x in points["ids"]), (list(x) for x in points["v"]),
                              strict=True))
            ids, vectors = [x for x, _ in held], scaled(np.array([x for _, x in held], float))
            searcher = Searcher(unit(vectors), leaf, count + 1, factor)
            asked = asked.reset_index(drop=True)
            wanted = scaled(np.array(asked["v"].tolist(), float))
            rows, levels = searcher.search(unit(wanted), asked["ball"].to_numpy(float))
            out = []
            lengths = np.linalg.norm(vectors, axis=1)
            for i, own in enumerate(asked["id"].tolist()):
                length = np.linalg.norm(wanted[i])
                real = rows[i] >= 0
                for r, at in zip(rows[i][real], levels[i][real].tolist(), strict=True):
                    score = float(np.dot(wanted[i], vectors[r]) / (length * lengths[r]))
                    away = float(chord(np.float64(score)))
                    out += [(own, other, away, at, score) for other in ids[r] if other != own]
            return pd.DataFrame(out, columns=names)

        key = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
        sent = queries.select("shard", key, "id", "v", "ball")
        copied = placed.join(queries.select("shard", key).distinct(), "shard")
        return (copied.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
                .applyInPandas(run, "query_id long, vec_id long, distance double, level long, score double"))


def _homes(batches: Iterator[pd.DataFrame], tree: Tree) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shard = home(tree, unit(np.array(batch["v"].tolist(), float))) if len(batch) else []
        yield pd.DataFrame({"shard": shard, "v": batch["v"], "ids": batch["ids"]})


def _asked(batches: Iterator[pd.DataFrame], tree: Tree) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shard = home(tree, unit(np.array(batch["v"].tolist(), float))) if len(batch) else []
        yield pd.DataFrame({"shard": shard, "id": batch["id"], "v": batch["v"]})


def _others(batches: Iterator[pd.DataFrame], tree: Tree, factor: float) -> Iterator[pd.DataFrame]:
    """A row per further shard that a query's ball may touch."""
    for batch in batches:
        out = []
        for shard, own, v, ball in zip(batch["shard"], batch["id"], batch["v"], batch["ball"],
                                       strict=True):
            query = unit(np.array([v], float))[0]
            out += [(other, own, v, ball) for other in reached(tree, query, factor * ball)
                    if other != shard]
        yield pd.DataFrame(out, columns=["shard", "id", "v", "ball"])
