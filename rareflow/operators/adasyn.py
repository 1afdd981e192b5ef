"""Adaptive synthetic sampling: more new rows where the other class is dense.

The density of a minority row is the number of its k nearest rows, of both classes, that are of another
class. New rows are shared out in proportion to it, in whole numbers: each row gets its share rounded
down, and the rows with the largest remainders one more. Shares depend on the density only,
so k + 1 counts decide them, and one class of density at most is cut by hash order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rareflow.operators.neighbours import k_nearest
from rareflow.operators.ordering import HashOrder
from rareflow.operators.smote import interpolated, with_synthetic
from rareflow.session import materialize


def densities(df: DataFrame, target: str, key: str, features: str, k: int, minority: int) -> DataFrame:
    """(key, features, density) of the minority rows."""
    near = k_nearest(df, key, features, k, asked=F.col(target) == minority)
    points = df.where(F.col(target) == minority).select(key, features)
    # only minority ids have to meet the neighbours; the others are what is left
    ids = points.select(F.col(key).alias("__other"), F.lit(1).alias("__same"))
    same = (near.select(key, F.explode("neighbours.id").alias("__other")).join(ids, "__other")
            .groupBy(key).agg(F.sum("__same").alias("__same")))
    sizes = near.select(key, F.size("neighbours").alias("__all"))
    return points.join(sizes, key).join(same, key, "left").select(
        key, features, (F.col("__all") - F.coalesce("__same", F.lit(0))).alias("density"))


def shares(counts: Mapping[int, int], total: int) -> tuple[dict[int, int], int | None, int]:
    """(rows per minority row by density, density that is cut, rows of it that get one more)."""
    weight = sum(d * n for d, n in counts.items())
    each = {d: d * total // weight for d in counts}
    left = total - sum(each[d] * n for d, n in counts.items())
    for d in sorted(counts, key=lambda d: (-(d * total % weight), -d)):
        if left < counts[d]:
            return each, d, left
        each[d] += 1
        left -= counts[d]
    return each, None, 0


def adaptive_rows(df: DataFrame, target: str, key: str, features: str, k: int = 5,
                  seed: str = "adasyn", minority: int = 1, percent: int = 100) -> DataFrame:
    """(key, copy, neighbour, gap, features): exactly ``percent`` of the missing minority rows.

    Remainders that tie go to the denser rows, then by hash order. A new row lies between a minority row
    and one of its k nearest minority rows; neighbour and gap are drawn by keyed hash. ``key``
    must be unique. No row with a neighbour of another class is an error, as are k or
    fewer minority rows.
    """
    counts = {r[target]: r["n"] for r in
              df.groupBy(target).agg(F.count("*").alias("n")).collect()}
    small = counts.get(minority, 0)
    total = (max(counts.values(), default=0) - small) * percent // 100
    if small <= k:
        raise ValueError(f"{small} minority rows are too few for {k} neighbours")
    points = materialize(densities(df, target, key, features, k, minority), "densities")
    dense = {r["density"]: r["n"] for r in
             points.groupBy("density").agg(F.count("*").alias("n")).collect()}
    if not any(dense):
        raise ValueError("no minority row has a neighbour of another class")
    each, cut, left = shares(dense, total)
    times = F.lit(0).cast("long")
    for density, rows in each.items():
        times = F.when(F.col("density") == density, F.lit(rows).cast("long")).otherwise(times)
    bases = points.withColumn("__times", times)
    if cut is not None and left:
        more, others = HashOrder(bases.where(F.col("density") == cut), key, f"{seed}:extra").split(left)
        bases = (bases.where(F.col("density") != cut).unionByName(others)
                 .unionByName(more.withColumn("__times", F.col("__times") + 1)))
    bases = bases.drop("density").where("__times > 0")
    return interpolated(bases, k_nearest(points, key, features, k), points, small, key, features,
                        seed)


def adasyn(df: DataFrame, target: str, key: str, features: str, k: int = 5, seed: str = "adasyn",
           minority: int = 1, percent: int = 100) -> DataFrame:
    """Original and synthetic rows together: (key text, features, target, synthetic)."""
    new = adaptive_rows(df, target, key, features, k, seed, minority, percent)
    return with_synthetic(df, new, target, key, features, minority)
