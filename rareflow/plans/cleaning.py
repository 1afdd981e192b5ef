"""Projections, filters, scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.functions.scores import predicted_class, softmax_positive
from rareflow.operators import clean, matrix
from rareflow.operators.profile import cardinality_profile
from rareflow.operators.series import clean_tags
from rareflow.plans.registry import CELLS, IMPRESSIONS, LINES, SCORES, query, r, with_
from rareflow.sources.tables import (
    CONTINUOUS, IGNORED, KEY, ONEHOT_AND_INDEX, TARGET, impressions, lines, scores, table, vectors)

FEATURES = [*ONEHOT_AND_INDEX, *CONTINUOUS]


def counts_sql(columns: list[str], source: str, position: bool = False) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {f'{i} AS position, ' if position else ''}'{c}' AS \"column\", "
        f"count({c}) AS n FROM {source}" for i, c in enumerate(columns))


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n): the columns of a table with their non-null counts."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "n")


@query("drop_constant_columns", with_(IMPRESSIONS, counts_sql([*FEATURES, TARGET], "impressions")))
def drop_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir).drop(KEY)
    return column_counts(clean.drop_constant_columns(df, keep=[TARGET]))


@query("drop_columns", with_(LINES, "SELECT * EXCLUDE (l_orderkey, column_weights) FROM lines"))
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).drop("l_orderkey", "column_weights")


@query("assign_feature_roles", with_(IMPRESSIONS, "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS cardinality,
  CASE WHEN count(DISTINCT {c}) <= 1 OR '{c}' = 'column_weights' THEN 'drop'
  {f"ELSE 'continuous'" if c in CONTINUOUS else f"WHEN count(DISTINCT {c}) <= 20 THEN 'onehot' ELSE 'index'"}
  END AS role FROM impressions""" for c in [*FEATURES, *IGNORED])))
def assign_feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir).drop(KEY)
    profile = cardinality_profile(df, df.columns).persist()
    spec = clean.assign_roles(profile, ONEHOT_AND_INDEX, CONTINUOUS, IGNORED, TARGET)
    return clean.role_table(profile, spec)


FAMILY = {"l_quantity": "exchange_ctr", "l_tax": "site_bpr", "l_extendedprice": "pixel_value",
          "column_weights": "column_weights"}


@query("select_continuous", with_(LINES, """SELECT l_quantity AS exchange_ctr, l_tax AS site_bpr,
  l_extendedprice AS pixel_value FROM lines"""))
def select_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lines(spark, sf_dir).select("l_returnflag", *[F.col(a).alias(b)
                                                          for a, b in FAMILY.items()])
    return clean.select_continuous(named)


@query("impute_categorical", with_(IMPRESSIONS, """SELECT coalesce(o_orderpriority, '-1')
  AS o_orderpriority, count(*) AS n FROM impressions GROUP BY 1"""))
def impute_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.impute(impressions(spark, sf_dir), categorical=["o_orderpriority"]) \
        .groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("impute_continuous", with_(LINES, "SELECT row_key, coalesce(l_tax, 0) AS l_tax FROM lines"))
def impute_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.impute(lines(spark, sf_dir).select(KEY, "l_tax"), continuous=["l_tax"])


@query("normalize_missing", with_(LINES, """SELECT CASE l_returnflag WHEN 'A' THEN NULL
  WHEN 'N' THEN NULL ELSE l_returnflag END AS l_returnflag, count(*) AS n,
  count(l_tax) AS taxed, round(sum(l_tax), 4) AS tax FROM lines GROUP BY 1"""))
def normalize_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    dirty = lines(spark, sf_dir).select(
        F.when(flag == "A", F.lit("nan")).when(flag == "N", F.lit(" ")).otherwise(flag)
        .alias("l_returnflag"),
        F.coalesce("l_tax", F.lit(float("nan"))).alias("l_tax"))
    return clean.normalize_missing(dirty).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("l_tax").alias("taxed"), r(F.sum("l_tax"), 4).alias("tax"))


ORDERED = [*sorted(["l_returnflag", "l_quantity", "l_tax", "l_linestatus"]), TARGET]


@query("order_columns", with_(LINES, counts_sql(ORDERED, "lines", position=True)))
def order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = lines(spark, sf_dir).select("l_tax", TARGET, "l_returnflag", "l_quantity",
                                        "l_linestatus")
    ordered = clean.order_columns(mixed, TARGET)
    position = F.lit(None).cast("int")
    for i, c in enumerate(ordered.columns):
        position = F.when(F.col("column") == c, F.lit(i)).otherwise(position)
    return column_counts(ordered).select(position.alias("position"), "column", "n")


@query("split_features_target", with_(LINES, f"""{counts_sql(['l_quantity', 'l_tax'], 'lines')}
  UNION ALL SELECT 'target', CAST(sum(conversion_target) AS BIGINT) FROM lines"""))
def split_features_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = clean.split_features_target(
        lines(spark, sf_dir).select("l_quantity", "l_tax", TARGET), TARGET)
    return column_counts(x).unionByName(
        y.agg(F.lit("target").alias("column"), F.sum(TARGET).alias("n")))


@query("onehot_label", with_(LINES, """SELECT row_key, 1 - conversion_target AS negative,
  conversion_target AS positive FROM lines"""))
def onehot_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(KEY, *clean.label_pair(F.col(TARGET)))


@query("filter_class", with_(LINES, """SELECT row_key, l_quantity FROM lines
  WHERE conversion_target = 1"""))
def filter_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filter_class(lines(spark, sf_dir), TARGET, 1).select(KEY, "l_quantity")


@query("cast_category_text", """SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def cast_category_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_linenumber", "l_suppkey"]
    return clean.cast_category_text(table(spark, sf_dir, "lineitem").select(*columns), columns) \
        .groupBy(*columns).agg(F.count("*").alias("n"))


@query("cast_numeric_int", """SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT)
  AS l_extendedprice, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity FROM lineitem""")
def cast_numeric_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cast_numeric_int(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"),
        ["l_extendedprice", "l_quantity"])


@query("threshold_predictions", with_(SCORES, """SELECT row_key,
  CAST(1 - score >= 0.5 AS INTEGER) AS negative, CAST(score >= 0.5 AS INTEGER) AS positive
  FROM scores"""))
def threshold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select(
        KEY, predicted_class(F.lit(1.0) - F.col("score")).alias("negative"),
        predicted_class(F.col("score")).alias("positive"))


@query("softmax_binary", with_(LINES, """SELECT row_key,
  round(exp(l_quantity / 10) / (exp(l_quantity / 10) + exp(coalesce(l_tax, 0) * 40)), 6)
  AS probability FROM lines"""))
def softmax_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit0, logit1 = F.coalesce("l_tax", F.lit(0.0)) * 40, F.col("l_quantity") / 10
    return lines(spark, sf_dir).select(KEY, r(softmax_positive(logit0, logit1))
                                       .alias("probability"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a fixed stand-in transform of themselves: x -> 9 x + 0.05."""
    return vectors(spark, sf_dir).withColumn(
        "diff", matrix.abs_diff("features", F.transform("features", lambda x: x * 9 + 0.05)))


DIFF = CELLS + """, diffs AS (SELECT vec_id, pos, abs(value - (value * 9 + CAST('0.05' AS DOUBLE)))
  AS value FROM cells)"""


@query("shift_abs_diff", with_(DIFF, "SELECT vec_id, pos, round(value, 6) AS value FROM diffs"))
def shift_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cells(shifted(spark, sf_dir), ["vec_id"], "diff").select(
        "vec_id", "pos", r("value").alias("value"))


@query("clip_rescale", with_(DIFF + """, clipped AS (SELECT vec_id, pos,
  least(greatest(value, 0), 0.2::DOUBLE) AS value FROM diffs)""", """SELECT vec_id, pos,
  round((value - (SELECT min(value) FROM clipped)) / (SELECT max(value) FROM clipped), 6)
  AS value FROM clipped"""))
def clip_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cells(matrix.clip_rescale(shifted(spark, sf_dir), "diff"), ["vec_id"], "diff") \
        .select("vec_id", "pos", r("value").alias("value"))


@query("double_log_scale", with_(DIFF + """, logged AS (SELECT vec_id, pos,
  ln(ln(value - (SELECT min(value) FROM diffs) + 1) + 1) AS value FROM diffs)""", """SELECT vec_id,
  pos, round((value - (SELECT min(value) FROM logged)) / (SELECT max(value) FROM logged), 6)
  AS value FROM logged"""))
def double_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cells(matrix.double_log_scale(shifted(spark, sf_dir), "diff"), ["vec_id"],
                        "diff").select("vec_id", "pos", r("value").alias("value"))


@query("value_band_filter", with_(DIFF, """SELECT CASE WHEN value > 1 THEN 'above' ELSE 'below' END
  AS side, count(*) AS n, round(sum(value), 4) AS total FROM diffs WHERE value <> 1 GROUP BY 1"""))
def value_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shifted(spark, sf_dir)
    parts = [matrix.band(df, "diff", [], above).agg(
        F.lit(side).alias("side"), F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))
        for side, above in (("above", True), ("below", False))]
    return parts[0].unionByName(parts[1])


@query("metric_tag_clean", """SELECT upper(substr(words, 1, 1)) || substr(words, 2) AS tag,
  count(*) AS n FROM (SELECT replace('validation_' || lower(event_type), '_', ' ') AS words
  FROM events) GROUP BY 1""")
def metric_tag_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        F.concat(F.lit("Dan/Validation_"), F.upper("event_type")).alias("tag"))
    return clean_tags(raw).groupBy("tag").agg(F.count("*").alias("n"))


@query("head_sample", with_(LINES, """SELECT row_key, l_quantity FROM lines
  WHERE conversion_target = 0 ORDER BY row_key LIMIT 400"""))
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.head_of_class(lines(spark, sf_dir).select(KEY, "l_quantity", TARGET),
                               TARGET, 0, KEY).drop(TARGET)
