"""Profiling aggregations: one pass over the table, one shuffle on (column, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from rareflow.operators.ordering import moments_and_quantiles, null_safe_join, running_before
from rareflow.session import materialize


def melt(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """(column, value) rows; built-in Expand, no shuffle."""
    return (df.select(*[F.col(c).cast(cast).alias(c) for c in columns])
            .unpivot([], list(columns), "column", "value"))


WHOLE = ("tinyint", "smallint", "int", "bigint")


def whole_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold whole numbers."""
    kinds = dict(df.dtypes)
    return [c for c in columns if kinds[c] in WHOLE]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-null values; hot values shrink map-side. If all columns hold
    whole numbers, these are counted as numbers and a text is made per value, not per row."""
    whole = columns and len(whole_columns(df, columns)) == len(columns)
    counts = (melt(df, columns, "bigint" if whole else "string").filter("value is not null")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    return counts.withColumn("value", F.col("value").cast("string")) if whole else counts


NUMBERS = {"tinyint": "double", "smallint": "double", "int": "double", "float": "double",
           "double": "double", "bigint": "bigint"}


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, a field per kind of column): a row per cell with its column's place and its value in
    the field of its kind, the others null; no shuffle.

    Numbers stay numbers: a text costs more to make, and takes more room, than the number.
    """
    kinds = {c: NUMBERS.get(kind, "string") for c, kind in df.select(*columns).dtypes}
    fields = sorted(set(kinds.values()))
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"),
                 *[(F.col(c) if k == kinds[c] else F.lit(None)).cast(k).alias(k) for k in fields])
        for i, c in enumerate(columns)])))


def cardinality_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False
                        ) -> DataFrame:
    """Distinct non-null values per column, zero for all-null columns."""
    if approximate:
        return melt(df, columns).groupBy("column").agg(
            F.approx_count_distinct("value").alias("cardinality"))
    values = cells(df, columns).distinct()
    known = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in values.columns[1:]])
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("at"))
    return values.groupBy("at").agg(F.count_if(known).alias("cardinality")).select(
        name.alias("column"), "cardinality")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(target, n, percent)."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return counts.select(target, "n", (F.lit(100.0) * F.col("n") / total).alias("percent"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column; count 0 and
    NULLs for a column without values."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return _moments_and_quartiles(melt(df, columns, "double"), "column", names)


def _moments_and_quartiles(rows: DataFrame, by: str, groups: DataFrame) -> DataFrame:
    """A row per group, NULL group included. The rows are read twice, and no row is written."""
    found = moments_and_quantiles(rows, [by], "value", QUARTILES)
    out = null_safe_join(groups.select(by), found, [by], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, percent) of the columns that hold nulls; one pass."""
    counts = df.agg(F.count("*").alias("__rows"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (counts.unpivot(["__rows"], list(columns), "column", "nulls").filter("nulls > 0")
            .select("column", "nulls",
                    (F.lit(100.0) * F.col("nulls") / F.col("__rows")).alias("percent")))


def build_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, idx): idx is the rank in lexicographic order. Written once: it is
    read per column and per use."""
    return ranked_values(value_counts(df, columns))


def ranked_values(counts: DataFrame) -> DataFrame:
    """The vocabulary of counted values (column, value, n)."""
    counted = materialize(counts.withColumn("one", F.lit(1)), "vocabulary")
    ranked = running_before(counted, ["column"], "value", ["one"])
    return materialize(ranked.select("column", "value", "n", F.col("one_before").cast("bigint")
                                     .alias("idx")), "vocabulary")


def merge_vocabulary(old: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the old codes; values not seen before get the next codes in text order."""
    fresh = value_counts(df, columns).select("column", "value").join(
        old.select("column", "value"), ["column", "value"], "left_anti")
    fresh = materialize(fresh.withColumn("one", F.lit(1)), "vocabulary-new")
    start = old.groupBy("column").agg((F.max("idx") + 1).alias("start"))
    added = (running_before(fresh, ["column"], "value", ["one"])
             .join(start, "column", "left")
             .select("column", "value",
                     (F.coalesce("start", F.lit(0)) + F.col("one_before")).cast("bigint")
                     .alias("idx")))
    return old.select("column", "value", "idx").unionByName(added)


def vocabulary_duplicates(vocabulary: DataFrame) -> DataFrame:
    """Columns whose text values repeat, with the number of surplus entries."""
    return (vocabulary.groupBy("column", F.col("value").cast("string").alias("value"))
            .agg(F.count("*").alias("n")).filter("n > 1")
            .groupBy("column").agg(F.sum(F.col("n") - 1).alias("duplicates")))


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, n) with the population deviation; nulls are skipped."""
    counts = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                               F.count(c).alias("n")).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "s").select("column", "s.*")


def imbalance_estimate(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target)
    counted = df.agg(F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    total = F.col("positives") + F.col("negatives")
    return counted.select(
        "positives", "negatives",
        (F.lit(100.0) * F.col("positives") / total).alias("positive_percent"),
        (F.lit(100.0) * F.col("negatives") / total).alias("negative_percent"))


def column_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns only one side has, with that side's non-null count."""
    only_left = [c for c in left.columns if c not in right.columns]
    only_right = [c for c in right.columns if c not in left.columns]

    def side(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        counts = df.agg(*[F.count(c).alias(c) for c in columns])
        return counts.unpivot([], columns, "column", "non_null").select(
            F.lit(name).alias("side"), "column", "non_null")

    parts = [side(d, cs, n) for d, cs, n in
             ((left, only_left, "left"), (right, only_right, "right")) if cs]
    if not parts:
        return left.sparkSession.createDataFrame([], "side string, column string, non_null bigint")
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, value: str, bins: int, limits: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes its right edge.

    ``limits`` (lo, hi in one row) if they are known more cheaply than from ``df``.
    """
    if limits is None:
        limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    position = F.when(width == 0, F.lit(0)).otherwise(
        F.floor((F.col(value) - lo) / width))
    return (df.filter(F.col(value).isNotNull())
            .select(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
            .groupBy("bin").agg(F.count("*").alias("n")))


def trial_summary(df: DataFrame, model: str, value: str) -> DataFrame:
    """Mean and box-plot numbers of a metric per model."""
    rows = df.select(model, F.col(value).alias("value"))
    out = _moments_and_quartiles(rows, model, df.select(model).distinct())
    return out.withColumnRenamed("n", "trials").drop("std")
