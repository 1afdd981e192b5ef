"""Cell-wise work on vector columns: shifts between rows and their transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def abs_diff(a: Column | str, b: Column | str) -> Column:
    """Element-wise |a - b| of two array columns."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def l1(values: Column | str) -> Column:
    """Sum of the (non-negative) cells of a row."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def cells(df: DataFrame, keep: Sequence[str], values: str) -> DataFrame:
    """One row per cell: (keep..., pos, value)."""
    return df.select(*keep, F.posexplode(values).alias("pos", "value"))


def clip_rescale(df: DataFrame, values: str, lo: float = 0.0, hi: float = 0.2) -> DataFrame:
    """Clip all cells, subtract the overall minimum, divide by the overall maximum."""
    clip = lambda x: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    clipped = df.withColumn(values, F.transform(values, clip))
    limits = clipped.agg(F.min(F.array_min(values)).alias("lo"),
                         F.max(F.array_max(values)).alias("hi"))
    low, high = limits.select("lo").scalar(), limits.select("hi").scalar()
    # subqueries stay outside the lambda, so each runs once
    bound = clipped.withColumns({"__lo": low, "__hi": high})
    return bound.withColumn(
        values, F.transform(values, lambda x: (x - F.col("__lo")) / F.col("__hi"))
    ).drop("__lo", "__hi")


def double_log_scale(df: DataFrame, values: str) -> DataFrame:
    """log(log(x - min + 1) + 1), then rescaled by its own minimum and maximum."""
    floor = df.agg(F.min(F.array_min(values)).alias("lo")).scalar()
    logged = df.withColumn("__lo", floor).withColumn(
        values, F.transform(values, lambda x: F.log1p(F.log1p(x - F.col("__lo"))))).drop("__lo")
    limits = logged.agg(F.min(F.array_min(values)).alias("lo"),
                        F.max(F.array_max(values)).alias("hi"))
    bound = logged.withColumns({"__lo": limits.select("lo").scalar(),
                                "__hi": limits.select("hi").scalar()})
    return bound.withColumn(
        values, F.transform(values, lambda x: (x - F.col("__lo")) / F.col("__hi"))
    ).drop("__lo", "__hi")


def band(df: DataFrame, values: str, keep: Sequence[str], above: bool, limit: float = 1.0
         ) -> DataFrame:
    """Cells strictly above, or strictly below, a limit."""
    value = F.col("value")
    return cells(df, keep, values).filter(value > limit if above else value < limit)


def cell_limits(df: DataFrame, values: str) -> DataFrame:
    """Minimum, maximum and mean over all cells; no explode needed."""
    return df.agg(
        F.min(F.array_min(values)).alias("min"), F.max(F.array_max(values)).alias("max"),
        (F.sum(l1(values)) / F.sum(F.size(values))).alias("mean"))


def shift_ranking(df: DataFrame, values: str) -> DataFrame:
    """Mean cell value per position (a few hundred rows), largest first."""
    return (cells(df, [], values).groupBy("pos").agg(F.avg("value").alias("mean_shift"))
            .orderBy(F.desc("mean_shift"), "pos"))


def top_and_bottom(ranking: DataFrame, n: int = 20) -> DataFrame:
    """First and last n of a ranking, tagged."""
    top = ranking.orderBy(F.desc("mean_shift"), "pos").limit(n)
    bottom = ranking.orderBy("mean_shift", F.desc("pos")).limit(n)
    return top.withColumn("side", F.lit("top")).unionByName(
        bottom.withColumn("side", F.lit("bottom")))


def embedded_offsets(dims: DataFrame) -> DataFrame:
    """(position, column, start, end) in embedded space, from
    (position, column, dim, embedded); plain columns have dim 1 and embedded false.

    One row per input column, so the ordered window is bounded metadata.
    """
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("dim").over(upto)
    return dims.select("position", "column", "dim", "embedded", (end - F.col("dim")).alias("start"),
                       end.alias("end"))


def feature_rollup(df: DataFrame, values: str, offsets: DataFrame) -> DataFrame:
    """Mean cell value per source feature and embedded name ``<column>_emb_<i>``.

    Sums are rounded to six digits first, so the order of summation cannot decide a tie.
    """
    means = cells(df, [], values).groupBy("pos").agg(
        (F.round(F.sum("value"), 6) / F.count("*")).alias("mean_shift"), F.count("*").alias("n"))
    names = offsets.select(
        "column", "embedded", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"),
        "start")
    label = F.when(F.col("embedded"), F.concat(
        "column", F.lit("_emb_"), (F.col("pos") - F.col("start")).cast("string"))
    ).otherwise(F.col("column"))
    # both sides have one row per vector position
    return means.join(names, "pos").select(
        F.col("pos").cast("int").alias("pos"), "column", label.alias("name"), "mean_shift", "n")
