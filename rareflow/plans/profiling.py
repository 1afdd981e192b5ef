"""Profiling aggregations (C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators import matrix, profile
from rareflow.operators.clean import filter_class
from rareflow.plans.cleaning import DIFF, shifted
from rareflow.plans.registry import (
    IMPRESSIONS, LINES, LOG, SCORES, SPLIT, query, r, rounded, with_)
from rareflow.sources.files import with_split
from rareflow.sources.tables import (
    CONTINUOUS, KEY, ONEHOT_AND_INDEX, TARGET, impressions, lines, metric_log, scores, table)

ALL_FEATURES = [*ONEHOT_AND_INDEX, *CONTINUOUS]


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


@query("cardinality_profile", with_(IMPRESSIONS, union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality FROM impressions"
    for c in [*ALL_FEATURES, "column_weights", TARGET])))
def cardinality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir).drop(KEY)
    return profile.cardinality_profile(df, df.columns)


BALANCE = """SELECT conversion_target, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM lines), 6) AS percent FROM lines GROUP BY 1"""


@query("class_balance", with_(LINES, BALANCE))
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.class_balance(lines(spark, sf_dir), TARGET), ["percent"])


@query("value_frequency", with_(LINES, "SELECT l_partkey, count(*) AS n FROM lines GROUP BY 1"))
def value_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_frequency(lines(spark, sf_dir), "l_partkey")


DESCRIBED = ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]


@query("describe_numeric", with_(IMPRESSIONS, union(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
  round(quantile_cont({c}, 0.75), 4) AS q75 FROM impressions""" for c in CONTINUOUS)))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.describe_numeric(impressions(spark, sf_dir), CONTINUOUS)
    return rounded(df, ["mean", "std", "q25", "q50", "q75"], 4)


NULLS = union(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
  round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS percent
  FROM source HAVING count(*) FILTER ({c} IS NULL) > 0""" for c in ALL_FEATURES)


@query("null_profile", with_(IMPRESSIONS + ", source AS (SELECT * FROM impressions)", NULLS))
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.null_profile(impressions(spark, sf_dir), ALL_FEATURES), ["percent"])


@query("null_profile_positive", with_(
    IMPRESSIONS + ", source AS (SELECT * FROM impressions WHERE conversion_target = 1)", NULLS))
def null_profile_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = filter_class(impressions(spark, sf_dir), TARGET, 1)
    return rounded(profile.null_profile(positives, ALL_FEATURES), ["percent"])


VOCABULARY_COLUMNS = ["l_returnflag", "l_linenumber", "l_suppkey", "l_partkey"]


@query("build_vocabulary", with_(LINES, union(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
  row_number() OVER (ORDER BY {c}) - 1 AS idx FROM lines WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in VOCABULARY_COLUMNS)))
def build_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.build_vocabulary(lines(spark, sf_dir), VOCABULARY_COLUMNS)


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the order number as a category and the split."""
    df = lines(spark, sf_dir).withColumn("l_orderkey", F.col("l_orderkey").cast("string"))
    return with_split(df, KEY)


MERGED = ["l_orderkey", "l_partkey"]


@query("merge_vocabulary", with_(f"{LINES}, {SPLIT}", union(
    f"""SELECT '{c}' AS "column", value, row_number() OVER (ORDER BY fresh, value) - 1 AS idx
  FROM (SELECT CAST({c} AS VARCHAR) AS value, min(CASE split WHEN 'train' THEN 0 ELSE 1 END)
    AS fresh FROM split_lines GROUP BY 1)""" for c in MERGED)))
def merge_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered_lines(spark, sf_dir)
    old = profile.build_vocabulary(df.filter("split = 'train'"), MERGED)
    return profile.merge_vocabulary(old, df.filter("split <> 'train'"), MERGED)


@query("vocabulary_duplicates", with_(f"{LINES}, {SPLIT}", union(
    f"""SELECT '{c}' AS "column", CAST(sum(splits - 1) AS BIGINT) AS duplicates
  FROM (SELECT {c}, count(DISTINCT split) AS splits FROM split_lines GROUP BY 1)
  WHERE splits > 1""" for c in ["l_returnflag", "l_partkey", "l_orderkey"])))
def vocabulary_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered_lines(spark, sf_dir)
    parts = [profile.value_counts(df.filter(F.col("split") == s),
                                  ["l_returnflag", "l_partkey", "l_orderkey"])
             for s in ("train", "validation", "test")]
    return profile.vocabulary_duplicates(reduce(DataFrame.unionByName, parts))


@query("numeric_stats", with_(IMPRESSIONS, union(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std,
  count({c}) AS n FROM impressions""" for c in [*CONTINUOUS, "column_weights"])))
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.numeric_stats(impressions(spark, sf_dir), [*CONTINUOUS, "column_weights"])
    return rounded(df, ["mean", "std"], 4)


@query("imbalance_estimate", with_(LINES, """SELECT
  count(*) FILTER (conversion_target = 1) AS positives,
  count(*) FILTER (conversion_target = 0) AS negatives,
  round(100.0 * count(*) FILTER (conversion_target = 1) / count(*), 6) AS positive_percent,
  round(100.0 * count(*) FILTER (conversion_target = 0) / count(*), 6) AS negative_percent
  FROM lines"""))
def imbalance_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.imbalance_estimate(lines(spark, sf_dir), TARGET),
                   ["positive_percent", "negative_percent"])


@query("column_set_diff", """SELECT 'left' AS side, 'o_totalprice' AS "column",
  count(o_totalprice) AS non_null FROM orders
  UNION ALL SELECT 'right', 'acctbal', count(c_acctbal) FROM customer
  UNION ALL SELECT 'right', 'mktsegment', count(c_mktsegment) FROM customer""")
def column_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"),
                                                 "o_totalprice")
    right = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"))
    return profile.column_set_diff(left, right)


@query("equi_width_histogram", with_(f"{DIFF}, {SCORES}", """SELECT 'shift' AS series,
  CAST(least(floor((value - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, count(*) AS n
  FROM diffs, (SELECT min(value) AS lo, max(value) AS hi FROM diffs) GROUP BY 1, 2
  UNION ALL SELECT 'score', CAST(least(floor((score - lo) / ((hi - lo) / 20)), 19) AS INTEGER),
  count(*) FROM scores, (SELECT min(score) AS lo, max(score) AS hi FROM scores) GROUP BY 1, 2"""))
def equi_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shifted(spark, sf_dir)
    limits = matrix.cell_limits(rows, "diff").select(F.col("min").alias("lo"), F.col("max").alias("hi"))
    first = profile.histogram(matrix.cells(rows, [], "diff"), "value", 100, limits).withColumn(
        "series", F.lit("shift"))
    second = profile.histogram(scores(spark, sf_dir), "score", 20).withColumn(
        "series", F.lit("score"))
    return first.unionByName(second)


RANKED = DIFF + """, ranking AS (SELECT pos, avg(value) AS mean_shift FROM diffs GROUP BY 1)"""


@query("feature_shift_ranking", with_(RANKED, """SELECT pos, round(mean_shift, 6) AS mean_shift,
  'top' AS side FROM (SELECT * FROM ranking ORDER BY mean_shift DESC, pos LIMIT 20)
  UNION ALL SELECT pos, round(mean_shift, 6), 'bottom'
  FROM (SELECT * FROM ranking ORDER BY mean_shift, pos DESC LIMIT 20)"""))
def feature_shift_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = matrix.shift_ranking(shifted(spark, sf_dir), "diff")
    return rounded(matrix.top_and_bottom(ranking), ["mean_shift"])


@query("row_shift_norm", with_(DIFF, """SELECT vec_id, round(sum(value), 6) AS norm
  FROM diffs GROUP BY 1"""))
def row_shift_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifted(spark, sf_dir).select("vec_id", r(matrix.l1("diff")).alias("norm"))


@query("global_min_max_mean", with_(DIFF, """SELECT round(min(value), 6) AS min,
  round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM diffs"""))
def global_min_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.cell_limits(shifted(spark, sf_dir), "diff"), ["min", "max", "mean"])


@query("trial_summary", with_(LOG, """SELECT tag, count(*) AS trials, round(avg(value), 6) AS mean,
  round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75 FROM metric_log GROUP BY 1"""))
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.trial_summary(metric_log(spark, sf_dir), "tag", "value")
    return rounded(df, ["mean", "min", "max", "q25", "q50", "q75"])
