"""Metric-log series (H) and the best logged score (F9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators import series
from rareflow.plans.registry import LOG, query, rounded, with_
from rareflow.sources.tables import metric_log

TAGS = ["click", "error", "purchase", "signup", "view"]
WIDE = LOG + ", wide AS (SELECT run, step, " + ", ".join(
    f"max(value) FILTER (tag = '{t}') AS {t}" for t in TAGS) + " FROM metric_log GROUP BY 1, 2)"
VALUES = ", ".join(f"round({t}, 6) AS {t}" for t in TAGS)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag the log holds; the SQL twins name the ones of the test tables."""
    return series.pivot_series(metric_log(spark, sf_dir), ["run", "step"])


def tags_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("run", "step")]


@query("metric_outer_join", with_(WIDE, f"SELECT run, step, {VALUES} FROM wide"))
def metric_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    return rounded(df, tags_of(df))


@query("log_union", with_(LOG, """SELECT run, step, tag, round(value, 6) AS value,
  CASE WHEN run = 2 THEN NULL ELSE run * 10 END AS shift FROM metric_log"""))
def log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rounded(metric_log(spark, sf_dir), ["value"])
    names = [r["run"] for r in log.select("run").distinct().collect()]   # NULL is a run too
    runs = {i: log.filter(F.col("run").eqNullSafe(F.lit(i))) for i in names}
    return series.union_logs([d if i == 2 else d.withColumn("shift", F.col("run") * 10)
                              for i, d in runs.items()])


NUMBERED = WIDE + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1" \
    " AS pos FROM wide), known AS (SELECT run, step, pos, " + ", ".join(
    f"""{t}, last_value({t} IGNORE NULLS) OVER b AS {t}_pv,
  last_value(CASE WHEN {t} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS {t}_pp,
  first_value({t} IGNORE NULLS) OVER a AS {t}_nv,
  first_value(CASE WHEN {t} IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS {t}_np"""
    for t in TAGS) + """ FROM numbered
  WINDOW b AS (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY run ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def interpolated(t: str) -> str:
    return f"""CASE WHEN {t} IS NOT NULL THEN {t} WHEN {t}_nv IS NULL THEN {t}_pv
  ELSE {t}_pv + ({t}_nv - {t}_pv) * ((pos - {t}_pp) / ({t}_np - {t}_pp)::DOUBLE) END"""


@query("interpolate_linear", with_(NUMBERED, "SELECT run, step, " + ", ".join(
    f"round({interpolated(t)}, 6) AS {t}" for t in TAGS) + " FROM known"))
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    return rounded(series.interpolate_linear(df, ["run"], "step", tags_of(df)), tags_of(df))


@query("backfill", with_(NUMBERED, "SELECT run, step, " + ", ".join(
    f"round(coalesce({t}, {t}_nv), 6) AS {t}" for t in TAGS) + " FROM known"))
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    return rounded(series.backfill(df, ["run"], "step", tags_of(df)), tags_of(df))


@query("fill_series", with_(NUMBERED, "SELECT run, step, " + ", ".join(
    f"round(coalesce({interpolated(t)}, {t}_nv), 6) AS {t}" for t in TAGS) + " FROM known"))
def fill_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    return rounded(series.fill_series(df, ["run"], "step", tags_of(df)), tags_of(df))


@query("series_dropna_sort", with_(WIDE, f"""SELECT run, step, {VALUES} FROM wide
  WHERE click IS NOT NULL AND view IS NOT NULL ORDER BY run, step"""))
def series_dropna_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = wide(spark, sf_dir)
    return series.dropna_sort(rounded(df, tags_of(df)), ["click", "view"],
                              ["run", "step"])


# Fixed value: the divisor of the published plot.
REGULARIZER_DIVISOR = 9.729614


@query("series_normalize", with_(LOG, f"""SELECT run, step, tag,
  round(value / CAST('{REGULARIZER_DIVISOR}' AS DOUBLE), 6) AS normalized FROM metric_log"""))
def series_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.normalize_series(metric_log(spark, sf_dir), "value", REGULARIZER_DIVISOR,
                                 "normalized")
    return rounded(df, ["normalized"])


@query("series_range", with_(LOG, """SELECT run, step, tag, round(value, 6) AS value FROM metric_log
  WHERE step BETWEEN 250 AND 400"""))
def series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.series_range(metric_log(spark, sf_dir), "step", 250, 400), ["value"])


@query("best_score_from_logs", with_(LOG, """SELECT round(max(value), 6) AS best FROM metric_log
  WHERE tag = 'view'"""))
def best_score_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.best_score(metric_log(spark, sf_dir), "view"), ["best"])
