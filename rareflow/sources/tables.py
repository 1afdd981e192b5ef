"""Stand-in inputs built from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TARGET = "conversion_target"
KEY = "row_key"
ONEHOT_AND_INDEX = ["l_returnflag", "l_linestatus", "l_linenumber", "o_orderstatus",
                    "o_orderpriority", "c_mktsegment", "c_nationkey", "l_suppkey", "l_partkey"]
CONTINUOUS = ["l_quantity", "l_extendedprice", "o_totalprice", "c_acctbal", "l_tax"]
IGNORED = ["column_weights"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents() -> Column:
    return F.floor(F.col("l_extendedprice") * 100 + 0.5)


def _target() -> Column:
    return (F.col("l_discount") >= 0.085).cast("int").alias(TARGET)


def _tax() -> Column:
    return F.nullif("l_tax", F.lit(0.0)).alias("l_tax")


def line_key(cents: Column) -> Column:
    """``row_key`` from a line's numbers and its price in cents."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents)
    return F.md5(key.cast("binary")).alias(KEY)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-level part of the impression table: no join."""
    text = [F.col(c).cast("string").alias(c) for c in ("l_linenumber", "l_suppkey", "l_partkey")]
    return table(spark, sf_dir, "lineitem").select(
        line_key(_cents()), "l_orderkey", "l_returnflag", "l_linestatus", *text, "l_quantity",
        "l_extendedprice", _tax(), F.lit(1.0).alias("column_weights"), _target())


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with order and customer features; keys and categories are still the tables' numbers.

    Orders meet customers first, so the large line table is shuffled only once.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
        "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = table(spark, sf_dir, "lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", _cents().alias("cents"), *ONEHOT_AND_INDEX,
                         *[_tax() if c == "l_tax" else c for c in CONTINUOUS], _target())


def as_impressions(joined: DataFrame, *more: str, text: bool = True) -> DataFrame:
    """The impression table from ``joined_lines``; ``more`` of its columns go along. Without ``text``
    categories that are numbers in the tables stay numbers."""
    categories = [F.col(c).cast("string").alias(c) if text else c for c in ONEHOT_AND_INDEX]
    return joined.select(line_key(F.col("cents")), *categories, *CONTINUOUS,
                         *[F.lit(1.0).alias(c) for c in IGNORED], TARGET, *more)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with order and customer features. Keys and texts of lines are made behind the join:
    the table's numbers are half as long."""
    return as_impressions(joined_lines(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-d vectors; label 0 is the positive class."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias(TARGET))


def scores(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A model-free score per line, with ties; ``more`` columns of the line go along."""
    part = F.substring(F.md5(F.concat(F.lit("score:"), F.col(KEY)).cast("binary")), 1, 4)
    base = F.conv(part, 16, 10).cast("int") / F.lit(65536.0)
    y = F.col(TARGET)
    return lines(spark, sf_dir).select(
        KEY, y.alias("y"),
        F.when(y == 1, F.least(base + 0.1, F.lit(1.0))).otherwise(base).alias("score"), *more)


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, tag, value): hourly means of the event values."""
    step = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return (table(spark, sf_dir, "events")
            .groupBy((F.col("user_id") % 3).alias("run"), step.alias("step"),
                     F.col("event_type").alias("tag"))
            .agg(F.avg("value").alias("value")))
