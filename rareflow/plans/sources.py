"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators.profile import build_vocabulary, cardinality_profile, numeric_stats
from rareflow.operators import metrics
from rareflow.plans.registry import (
    CELLS, LINES, SCORES, SPLIT, fraction_sql, normal_sql, query, r, with_)
from rareflow.session import scratch_path
from rareflow.sources import files, generators
from rareflow.sources.tables import (
    KEY, TARGET, lines, scores, table, vectors)

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]


@query("scan_csv_gz", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice "
                      "FROM orders")
def scan_csv_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    path = files.write_csv(orders, scratch_path(spark, "orders-gz"), "gzip")
    return files.scan_csv(spark, path, orders.schema)


@query("scan_class_dirs", with_(LINES, """SELECT CASE conversion_target WHEN 1 THEN 'positive'
  ELSE 'negative' END AS path_class, count(*) AS n, sum(l_quantity) AS quantity
  FROM lines GROUP BY 1"""))
def scan_class_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col(TARGET) == 1, F.lit("positive")).otherwise(F.lit("negative"))
    path = scratch_path(spark, "classes")
    lines(spark, sf_dir).withColumn("class", named).write.partitionBy("class").parquet(path)
    return files.with_path_class(spark.read.parquet(path)).groupBy("path_class").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


PERSON_COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                  "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
EXPECTED = sorted(c for cs in PERSON_COLUMNS.values() for c in cs)


@query("schema_consistency", "\nUNION ALL ".join(
    f"SELECT '{t}' AS source, '{c}' AS \"column\", {int(c in cs)} AS present, "
    f"{f'count({c})' if c in cs else 'count(*) * 0'} AS non_null FROM {t}"
    for t, cs in PERSON_COLUMNS.items() for c in EXPECTED))
def schema_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.schema_report({t: table(spark, sf_dir, t) for t in PERSON_COLUMNS}, EXPECTED)


@query("read_with_defaults", """SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '-1'
  ELSE o_orderpriority END AS o_orderpriority, count(*) AS n,
  round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END), 2) AS price
  FROM orders GROUP BY 1""")
def read_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"))
    path = files.write_csv(orders, scratch_path(spark, "orders-gaps"))
    read = files.scan_csv(spark, path, orders.schema)
    filled = files.fill_defaults(read, ["o_orderpriority"], ["o_totalprice"])
    return filled.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("price"))


@query("union_files", "SELECT * FROM customer")
def union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    low = F.coalesce(F.col("c_nationkey") < 12, F.lit(False))   # no key is lost
    parts = [files.write_csv(customer.filter(c), scratch_path(spark, "customer"))
             for c in (low, ~low)]
    return files.scan_csv(spark, parts, customer.schema)


COMMON = [KEY, "l_returnflag", "l_quantity", TARGET]


@query("union_common_columns", with_(LINES, f"SELECT {', '.join(COMMON)} FROM lines"))
def union_common_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.with_split(lines(spark, sf_dir), KEY)
    part = {s: df.filter(F.col("split") == s) for s in ("train", "validation", "test")}
    return files.union_common([
        part["train"].select(*COMMON, "l_tax", "column_weights"),
        part["validation"].select(*COMMON, "column_weights"),
        part["test"].select(*COMMON, "l_tax")])


@query("route_splits", with_(f"{LINES}, {SPLIT}", """SELECT split, count(*) AS n,
  CAST(sum(conversion_target) AS BIGINT) AS positives FROM split_lines GROUP BY 1"""))
def route_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    files.with_split(lines(spark, sf_dir), KEY).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n"), F.sum(TARGET).alias("positives"))


def shard_sql(shards: int) -> str:
    return f"""sharded AS (SELECT row_key, CAST(least((row_number() OVER (ORDER BY
  md5('shard:' || row_key)) - 1) // ((SELECT count(*) FROM lines) // {shards}), {shards})
  AS INTEGER) AS shard FROM lines)"""


@query("shard_table", with_(f"{LINES}, {shard_sql(100)}", "SELECT row_key, shard FROM sharded"))
def shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_shard(lines(spark, sf_dir).select(KEY), KEY, 100)


@query("read_shards", with_(f"{LINES}, {shard_sql(20)}",
                            "SELECT row_key, shard FROM sharded WHERE shard IN (0, 1)"))
def read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = files.with_shard(lines(spark, sf_dir).select(KEY), KEY, 20, piece="piece")
    path = files.write_shards(sharded, scratch_path(spark, "shards"), piece="piece")
    return files.read_shards(spark, path, [0, 1], KEY)


META_CATEGORIES = ["l_returnflag", "l_linestatus", "l_linenumber"]
META_NUMBERS = ["l_quantity", "l_extendedprice", "l_tax"]


@query("load_metadata", with_(LINES, "\nUNION ALL ".join(
    [f"""SELECT 'vocabulary' AS kind, '{c}' AS "column", v AS value,
  CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS number
  FROM (SELECT DISTINCT {c} AS v FROM lines WHERE {c} IS NOT NULL)""" for c in META_CATEGORIES]
    + [f"SELECT 'stats', '{c}', '{k}', round({f}({c}), 6) FROM lines"
       for c in META_NUMBERS for k, f in (("mean", "avg"), ("std", "stddev_pop"))]
    + [f"SELECT 'cardinality', '{c}', NULL, CAST(count(DISTINCT {c}) AS DOUBLE) FROM lines"
       for c in META_CATEGORIES])))
def load_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    path = files.save_metadata(
        build_vocabulary(df, META_CATEGORIES), numeric_stats(df, META_NUMBERS),
        cardinality_profile(df, META_CATEGORIES), scratch_path(spark, "metadata"))
    vocabulary, stats, cardinality = files.load_metadata(spark, path)
    return (
        vocabulary.select(F.lit("vocabulary").alias("kind"), "column", "value",
                          F.col("idx").cast("double").alias("number"))
        .unionByName(stats.unpivot("column", ["mean", "std"], "value", "number")
                     .select(F.lit("stats").alias("kind"), "column", "value",
                             r("number").alias("number")))
        .unionByName(cardinality.select(
            F.lit("cardinality").alias("kind"), "column", F.lit(None).cast("string").alias("value"),
            F.col("cardinality").cast("double").alias("number"))))


@query("load_matrix", with_(CELLS, """SELECT conversion_target AS label,
  1 - conversion_target AS negative, conversion_target AS positive, pos,
  count(*) AS n, round(avg(value), 6) AS mean FROM cells GROUP BY 1, 2, 3, 4"""))
def load_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = vectors(spark, sf_dir).select(
        "vec_id", TARGET, *[F.col("features")[i].alias(f"x{i:02d}") for i in range(64)])
    matrix = files.load_matrix(wide, [f"x{i:02d}" for i in range(64)], TARGET)
    cells = matrix.select("label", F.col("label_pair")[0].alias("negative"),
                          F.col("label_pair")[1].alias("positive"),
                          F.posexplode("features").alias("pos", "value"))
    return cells.groupBy("label", "negative", "positive", "pos").agg(
        F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("sample_count", with_(LINES, "SELECT count(*) AS samples FROM lines"))
def sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(F.count("*").alias("samples"))


RESULT_SQL = """SELECT 'run-1' AS run_id,
  round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15))
    ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END), 6) AS cross_entropy,
  round(avg((CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END
    + CASE WHEN (1 - score >= 0.5) = (y = 0) THEN 1.0 ELSE 0.0 END) / 2), 6) AS accuracy
  FROM scores"""


@query("write_results", with_(SCORES, RESULT_SQL))
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scores(spark, sf_dir)
    row = metrics.cross_entropy(df).withColumn("accuracy", metrics.accuracy(df).scalar())
    path = files.append_results(row, scratch_path(spark, "results"), "run-1")
    return spark.read.parquet(path).select(
        "run_id", r("cross_entropy").alias("cross_entropy"), r("accuracy").alias("accuracy"))


@query("gen_two_gaussians", with_(LINES, f"""SELECT row_key, label,
  round(CASE label WHEN 1 THEN 1 + 0.4 * x0 ELSE x0 END, 6) AS x0,
  round(CASE label WHEN 1 THEN 1 + 0.4 * x1 ELSE x1 END, 6) AS x1
  FROM (SELECT row_key, CAST(row_number() OVER (ORDER BY md5('gauss:label:' || row_key))
      <= round_even((SELECT count(*) FROM lines) * 0.1::DOUBLE, 0) AS INTEGER) AS label,
    {normal_sql("row_key", "gauss:x0")} AS x0, {normal_sql("row_key", "gauss:x1")} AS x1
  FROM lines)"""))
def gen_two_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = generators.two_gaussians(lines(spark, sf_dir), KEY)
    return df.select(KEY, "label", r("x0").alias("x0"), r("x1").alias("x1"))


@query("gen_mixed_table", with_(LINES, f"""SELECT row_key,
  round({normal_sql("row_key", "mixed:c0")}, 6) AS c0,
  round({normal_sql("row_key", "mixed:c1")}, 6) AS c1,
  {", ".join(f"CAST(floor({fraction_sql(f"'mixed:k{i}:' || row_key")} * {n}) AS INTEGER) AS k{i}"
             for i, n in enumerate((200, 100, 80, 50)))},
  CAST(floor({fraction_sql("'mixed:label:' || row_key")} * 2) AS INTEGER) AS label FROM lines"""))
def gen_mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = generators.mixed_table(lines(spark, sf_dir), KEY, 2, (200, 100, 80, 50))
    return df.withColumns({c: r(c) for c in ("c0", "c1")})
