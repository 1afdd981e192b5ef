"""Metric logs: wide tables of series, gap filling by row position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.functions.clean import tag_to_column
from rareflow.operators.ordering import BUCKET, SLICE_ROWS, null_safe_join, value_buckets
from rareflow.session import materialize


def log_tags(log: DataFrame) -> list[str]:
    """The tags a log holds, in order (metadata: one per metric)."""
    return sorted(r["tag"] for r in log.where("tag is not null").select("tag").distinct().collect())


def pivot_series(log: DataFrame, keys: Sequence[str], tags: Sequence[str] | None = None
                 ) -> DataFrame:
    """One column per tag, of the log's own tags by default; the same rows as a chain of
    full outer joins on the keys, with one shuffle."""
    tags = log_tags(log) if tags is None else list(tags)
    return log.groupBy(*keys).pivot("tag", tags).agg(F.first("value", ignorenulls=True))


def outer_join_series(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join of separate series tables, left to right."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), series)


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """Stack the logs of several runs; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def _neighbours(rows: DataFrame, by: list[str], order: str, columns: Sequence[str],
                slice_rows: int) -> DataFrame:
    """Add ``__pos`` and per column the nearest known (value, position) at or
    before (``__prev_c``) and at or after (``__next_c``) each row.

    Two levels: inside even slices of each group, then over one row per slice,
    so a single long run is not walked by one task.
    """
    rows = materialize(rows, "series")
    cut = value_buckets(rows, by, order, slice_rows)
    local = Window.partitionBy(*by, BUCKET).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in reverse order: frames that end at the last
    # row are recomputed for every row
    after = Window.partitionBy(*by, BUCKET).orderBy(F.desc(order)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    pos = F.row_number().over(local) - 1
    sizes = cut.groupBy(*by, BUCKET).agg(F.count("*").alias("__n"))
    slices = Window.partitionBy(*by).orderBy(BUCKET)
    offsets = sizes.select(*by, BUCKET, (F.sum("__n").over(slices) - F.col("__n")).alias("__off"))
    numbered = materialize(
        null_safe_join(cut, offsets, [*by, BUCKET]).withColumn("__pos", F.col("__off") + pos),
        "series-pos")
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(
        F.col(c).alias("value"), F.col("__pos").alias("pos")))
    edges = numbered.groupBy(*by, BUCKET).agg(
        *[F.max_by(known(c), F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__last_{c}")
          for c in columns],
        *[F.min_by(known(c), F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__first_{c}")
          for c in columns])
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc(BUCKET)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *by, BUCKET,
        *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__before_{c}")
          for c in columns],
        *[F.last(f"__first_{c}", ignorenulls=True).over(later).alias(f"__behind_{c}")
          for c in columns])
    joined = null_safe_join(numbered, carried, [*by, BUCKET])
    return joined.select(
        *rows.columns, "__pos",
        *[F.coalesce(F.last(known(c), ignorenulls=True).over(upto), F.col(f"__before_{c}"))
          .alias(f"__prev_{c}") for c in columns],
        *[F.coalesce(F.last(known(c), ignorenulls=True).over(after), F.col(f"__behind_{c}"))
          .alias(f"__next_{c}") for c in columns])


def _interpolated(c: str) -> Column:
    prev, nxt = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
    share = (F.col("__pos") - prev["pos"]) / (nxt["pos"] - prev["pos"])
    inner = prev["value"] + (nxt["value"] - prev["value"]) * share
    return (F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNull(), F.lit(None))
            .when(nxt.isNull(), prev["value"]).otherwise(inner))


def interpolate_linear(rows: DataFrame, by: Sequence[str], order: str, columns: Sequence[str],
                       slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fill inner gaps linearly by row position; trailing gaps repeat the last
    value, leading gaps stay. (by, order) must be unique."""
    found = _neighbours(rows, list(by), order, columns, slice_rows)
    keep = [c for c in rows.columns if c not in columns]
    return found.select(*keep, *[_interpolated(c).alias(c) for c in columns])


def backfill(rows: DataFrame, by: Sequence[str], order: str, columns: Sequence[str],
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every gap takes the next known value."""
    found = _neighbours(rows, list(by), order, columns, slice_rows)
    keep = [c for c in rows.columns if c not in columns]
    return found.select(*keep, *[F.coalesce(F.col(c), F.col(f"__next_{c}")["value"]).alias(c)
                                 for c in columns])


def fill_series(rows: DataFrame, by: Sequence[str], order: str, columns: Sequence[str],
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Interpolate, then backfill what is left: the log converter's result."""
    found = _neighbours(rows, list(by), order, columns, slice_rows)
    keep = [c for c in rows.columns if c not in columns]
    return found.select(*keep, *[
        F.coalesce(_interpolated(c), F.col(f"__next_{c}")["value"]).alias(c) for c in columns])


def dropna_sort(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.na.drop(subset=list(columns)).orderBy(*order)


def normalize_series(rows: DataFrame, column: str, divisor: float, name: str) -> DataFrame:
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, (F.col(column) / F.lit(divisor)).alias(name))


def series_range(rows: DataFrame, order: str, low: int, high: int) -> DataFrame:
    return rows.filter(F.col(order).between(low, high))


def clean_tags(log: DataFrame) -> DataFrame:
    return log.withColumn("tag", tag_to_column(F.col("tag")))


def best_score(log: DataFrame, tag: str) -> DataFrame:
    """Best logged value of a tag, -infinity when there is none."""
    return log.filter(F.col("tag") == tag).agg(
        F.coalesce(F.max("value"), F.lit(float("-inf"))).alias("best"))
