"""Synthetic minority rows between near minority neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rareflow.functions.hashing import hash_fraction
from rareflow.operators.encode import dictionary_join
from rareflow.operators.neighbours import k_nearest
from rareflow.operators.ordering import HashOrder
from rareflow.session import materialize


def synthetic_rows(df: DataFrame, target: str, key: str, features: str, k: int = 20,
                   seed: str = "smote", minority: int = 1) -> DataFrame:
    """(key, copy, neighbour, gap, features): exactly enough rows to equalise two classes.

    Each minority row gets the same number of synthetic rows; the remainder goes
    to the first rows in hash order. Neighbour and gap are drawn by keyed hash.
    """
    counts = {r[target]: r["n"] for r in
              df.groupBy(target).agg(F.count("*").alias("n")).collect()}
    small = counts.get(minority, 0)
    missing = max(counts.values(), default=0) - small
    if small <= k:
        raise ValueError(f"{small} minority rows are too few for {k} neighbours")
    points = materialize(df.filter(F.col(target) == minority).select(key, features), "minority")
    extra, plain = HashOrder(points, key, f"{seed}:extra").split(missing % small)
    each = missing // small
    bases = (extra.withColumn("__times", F.lit(each + 1))
             .unionByName(plain.withColumn("__times", F.lit(each))).filter("__times > 0"))
    return interpolated(bases, k_nearest(points, key, features, k), points, small, key, features,
                        seed)


def interpolated(bases: DataFrame, near: DataFrame, points: DataFrame, small: int, key: str,
                 features: str, seed: str) -> DataFrame:
    """``__times`` rows per base, each on the line to one of its ``near`` rows.

    ``points`` holds the ``small`` rows the neighbours are taken from.
    """
    drawn = (
        bases.join(near, key)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
        .withColumn("__draw", F.concat_ws(":", F.col(key).cast("string"), F.col("copy"))))
    choice = F.floor(hash_fraction("__draw", f"{seed}:neighbour") * F.size("neighbours")).cast("int")
    drawn = drawn.select(
        key, "copy", features, hash_fraction("__draw", f"{seed}:gap").alias("gap"),
        F.element_at("neighbours", choice + 1)["id"].alias("neighbour"))
    width = points.select(F.size(features)).first()[0]
    ends = dictionary_join(
        drawn, points.select(F.col(key).alias("value"), F.col(features).alias("end")),
        "neighbour", "end", "__end", small * (width + 3) * 8)
    between = F.zip_with(features, "__end", lambda a, b: a + (b - a) * F.col("gap"))
    return ends.withColumn(features, between).drop("__end")


def smote(df: DataFrame, target: str, key: str, features: str, k: int = 20,
          seed: str = "smote", minority: int = 1) -> DataFrame:
    """Original and synthetic rows together: (key text, features, target, synthetic)."""
    return with_synthetic(df, synthetic_rows(df, target, key, features, k, seed, minority),
                          target, key, features, minority)


def with_synthetic(df: DataFrame, new: DataFrame, target: str, key: str, features: str,
                   minority: int) -> DataFrame:
    name = F.concat_ws("+", F.col(key).cast("string"), F.col("copy").cast("string"))
    return df.select(F.col(key).cast("string").alias(key), features, target,
                     F.lit(0).alias("synthetic")).unionByName(
        new.select(name.alias(key), features, F.lit(minority).alias(target),
                   F.lit(1).alias("synthetic")))


def round_categories(features: Column | str, positions: Sequence[int]) -> Column:
    """Round the cells at the given positions half to even."""
    whole = F.array(*[F.lit(p) for p in positions]) if positions else F.array().cast("array<int>")
    return F.transform(features, lambda x, i: F.when(F.array_contains(whole, i), F.bround(x, 0))
                       .otherwise(x))
