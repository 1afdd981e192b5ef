"""Sampling and class rebalancing (E)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators import matrix, sample
from rareflow.operators.adasyn import adaptive_rows, densities
from rareflow.operators.smote import round_categories, synthetic_rows
from rareflow.plans.registry import (
    LINES, VECTORS, fraction_sql, query, rounded, with_)
from rareflow.sources.tables import KEY, TARGET, lines, table, vectors

KEPT = "row_key, conversion_target"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(KEY, TARGET)


def ranked(seed: str, by_class: bool = True) -> str:
    """CTEs: rows with their 1-based rank in hash order, and the class sizes."""
    part = "PARTITION BY conversion_target " if by_class else ""
    return LINES + f""", ranked AS (SELECT row_key, conversion_target, row_number() OVER ({part}
  ORDER BY md5('{seed}:' || row_key)) AS k FROM lines),
sizes AS (SELECT count(*) FILTER (conversion_target = 0) AS neg,
  count(*) FILTER (conversion_target = 1) AS pos, count(*) AS n FROM lines)"""


def pick(seed: str, neg: str, pos: str) -> str:
    return with_(ranked(seed), f"""SELECT {KEPT} FROM ranked, sizes
  WHERE k <= CASE conversion_target WHEN 1 THEN {pos} ELSE {neg} END""")


@query("rebalance_validation", pick("rebalance", "neg",
                                    "round_even(11 * neg / CAST(89 AS DOUBLE), 0)"))
def rebalance_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.rebalance(base(spark, sf_dir), TARGET, KEY, 11)


@query("sample_n", with_(ranked("sample", False), f"SELECT {KEPT} FROM ranked WHERE k <= 5000"))
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_n(base(spark, sf_dir), KEY, 5000)


@query("sample_balanced", pick("balanced", "500", "500"))
def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_balanced(base(spark, sf_dir), TARGET, KEY, 1000)


@query("sample_fixed_percentage", pick("shares", "1500", "500"))
def sample_fixed_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_shares(base(spark, sf_dir), TARGET, KEY, 2000, {0: 75, 1: 25})


DRAWS = sample.drawn_shards(40, 4, True, "thin:draw")


@query("thin_positive_shards", with_(
    f"{ranked('thin')}, draws(shard) AS (VALUES {', '.join(f'({d})' for d in DRAWS)})",
    f"""SELECT {KEPT}, CAST(copy AS INTEGER) AS copy FROM (SELECT {KEPT},
  CASE WHEN conversion_target = 0 THEN 1
  ELSE 2 * (SELECT count(*) FROM draws WHERE shard = least((k - 1) // (pos // 40), 40)) END
  AS copies FROM ranked, sizes), range(1, 9) AS g(copy) WHERE copy <= copies"""))
def thin_positive_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.thin_positive_shards(base(spark, sf_dir), TARGET, KEY, 40, 0.1, 2).select(
        KEY, TARGET, "copy")


@query("oversample_positive", with_(LINES, f"""SELECT {KEPT}, CAST(copy AS INTEGER) AS copy
  FROM lines, range(1, 11) AS g(copy)
  WHERE copy <= CASE conversion_target WHEN 1 THEN 10 ELSE 1 END"""))
def oversample_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.oversample(base(spark, sf_dir), TARGET, 10)


@query("undersample_negative", pick("undersample", "pos", "pos"))
def undersample_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.undersample(base(spark, sf_dir), TARGET, KEY)


@query("undersample_negative_shards", with_(ranked("undersample"), f"""SELECT {KEPT}
  FROM ranked, sizes WHERE conversion_target = 1 OR least((k - 1) // (neg // 100), 100) < 14"""))
def undersample_negative_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.undersample_shards(base(spark, sf_dir), TARGET, KEY, 100, 14).select(KEY, TARGET)


@query("cap_class_rows", pick("cap", "100000", "12500"))
def cap_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.cap_classes(base(spark, sf_dir), TARGET, KEY, 12_500, 100_000)


@query("stratified_split", with_(ranked("split"), f"""SELECT {KEPT},
  CASE WHEN k <= floor(CAST('0.8' AS DOUBLE) * CASE conversion_target WHEN 1 THEN pos ELSE neg END)
  THEN 'train' ELSE 'test' END AS part FROM ranked, sizes"""))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sample.stratified_mark(base(spark, sf_dir), TARGET, KEY)
    part = F.when(F.col("in_train") == 1, F.lit("train")).otherwise(F.lit("test"))
    return marked.select(KEY, TARGET, part.alias("part"))


@query("shuffle_rows", with_(LINES, f"SELECT {KEPT} FROM lines"))
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.shuffle_rows(base(spark, sf_dir), KEY)


def uniform(key: str, seed: str) -> str:
    return fraction_sql(f"'{seed}:' || {key}")


# The nearest neighbours in SQL compare all pairs of the minority rows.
SMOTE = VECTORS + f""", minority AS (SELECT vec_id, features FROM vectors
  WHERE conversion_target = 1),
sizes AS (SELECT count(*) FILTER (conversion_target = 1) AS m,
  count(*) FILTER (conversion_target = 0) - count(*) FILTER (conversion_target = 1) AS missing
  FROM vectors),
near AS (SELECT vec_id, list(other ORDER BY distance, other)[1:20] AS ids FROM (
  SELECT a.vec_id, b.vec_id AS other, list_distance(a.features, b.features) AS distance
  FROM minority a JOIN minority b ON a.vec_id <> b.vec_id) GROUP BY 1),
times AS (SELECT vec_id, missing // m + CAST(row_number() OVER (
  ORDER BY md5('smote:extra:' || vec_id)) <= missing % m AS INTEGER) AS copies
  FROM minority, sizes),
drawn AS (SELECT vec_id, CAST(copy AS INTEGER) AS copy,
  {uniform("vec_id || ':' || copy", "smote:gap")} AS gap,
  ids[CAST(floor({uniform("vec_id || ':' || copy", "smote:neighbour")} * 20) AS INTEGER) + 1]
    AS neighbour
  FROM times JOIN near USING (vec_id), range(1, 1000) AS g(copy) WHERE copy <= copies)"""


@query("smote", with_(SMOTE, """SELECT d.vec_id, copy, neighbour, round(gap, 6) AS gap,
  CAST(i - 1 AS INTEGER) AS pos,
  round(a.features[i] + (b.features[i] - a.features[i]) * gap, 6) AS value
  FROM drawn d JOIN minority a ON d.vec_id = a.vec_id JOIN minority b ON neighbour = b.vec_id,
  range(1, 65) AS g(i)"""))
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = synthetic_rows(vectors(spark, sf_dir), TARGET, "vec_id", "features", 20)
    return rounded(matrix.cells(new, ["vec_id", "copy", "neighbour", "gap"], "features"),
                   ["gap", "value"])


@query("smote_round_categories", with_(SMOTE, """SELECT d.vec_id, copy,
  CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i <= 3
  THEN round_even(10 * (a.features[i] + (b.features[i] - a.features[i]) * gap), 0) + 0
  ELSE round(10 * (a.features[i] + (b.features[i] - a.features[i]) * gap), 6) END AS value
  FROM drawn d JOIN minority a ON d.vec_id = a.vec_id JOIN minority b ON neighbour = b.vec_id,
  range(1, 65) AS g(i)"""))
def smote_round_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = synthetic_rows(vectors(spark, sf_dir), TARGET, "vec_id", "features", 20)
    tens = F.transform("features", lambda x: x * 10)
    whole = new.select("vec_id", "copy", round_categories(tens, [0, 1, 2]).alias("features"))
    return rounded(matrix.cells(whole, ["vec_id", "copy"], "features"), ["value"])


# Densities over all pairs of a minority row and another row; shares by remainders of integers.
ADASYN = VECTORS + f""", minority AS (SELECT vec_id, features FROM vectors
  WHERE conversion_target = 1),
sizes AS (SELECT count(*) FILTER (conversion_target = 0) - count(*) FILTER (conversion_target = 1)
  AS missing FROM vectors),
ranked AS (SELECT a.vec_id, b.vec_id AS other, conversion_target, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY list_distance(a.features, b.features), b.vec_id) AS k
  FROM minority a JOIN vectors b ON a.vec_id <> b.vec_id),
dense AS (SELECT vec_id, CAST(count(*) FILTER (conversion_target = 0) AS INTEGER) AS density
  FROM ranked WHERE k <= 20 GROUP BY 1),
total AS (SELECT sum(density) AS weight FROM dense),
parts AS (SELECT vec_id, density, CAST(density * missing // weight AS BIGINT) AS whole,
  density * missing % weight AS remainder, missing FROM dense, sizes, total),
times AS (SELECT vec_id, whole + CAST(row_number() OVER (ORDER BY remainder DESC, density DESC,
    md5('adasyn:extra:' || vec_id)) <= missing - (SELECT sum(whole) FROM parts) AS INTEGER) AS copies
  FROM parts),
near AS (SELECT vec_id, list(other ORDER BY distance, other)[1:20] AS ids FROM (
  SELECT a.vec_id, b.vec_id AS other, list_distance(a.features, b.features) AS distance
  FROM minority a JOIN minority b ON a.vec_id <> b.vec_id) GROUP BY 1),
drawn AS (SELECT vec_id, CAST(copy AS INTEGER) AS copy,
  {uniform("vec_id || ':' || copy", "adasyn:gap")} AS gap,
  ids[CAST(floor({uniform("vec_id || ':' || copy", "adasyn:neighbour")} * 20) AS INTEGER) + 1]
    AS neighbour
  FROM times JOIN near USING (vec_id), range(1, 10000) AS g(copy) WHERE copy <= copies)"""


@query("adasyn_density", with_(ADASYN, "SELECT vec_id, density FROM dense"))
def adasyn_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities(vectors(spark, sf_dir), TARGET, "vec_id", "features", 20, 1).select(
        "vec_id", "density")


@query("adasyn", with_(ADASYN, """SELECT d.vec_id, copy, neighbour, round(gap, 6) AS gap,
  CAST(i - 1 AS INTEGER) AS pos,
  round(a.features[i] + (b.features[i] - a.features[i]) * gap, 6) AS value
  FROM drawn d JOIN minority a ON d.vec_id = a.vec_id JOIN minority b ON neighbour = b.vec_id,
  range(1, 65) AS g(i)"""))
def adasyn(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = adaptive_rows(vectors(spark, sf_dir), TARGET, "vec_id", "features", 20)
    return rounded(matrix.cells(new, ["vec_id", "copy", "neighbour", "gap"], "features"),
                   ["gap", "value"])


@query("class_mixed_batches", with_(ranked("mix"), f"""SELECT {KEPT}, CAST(floor((k - 1) * 16
  / CAST(CASE conversion_target WHEN 1 THEN pos ELSE neg END AS DOUBLE)) AS INTEGER) AS batch
  FROM ranked, sizes"""))
def class_mixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.mixed_batches(base(spark, sf_dir), TARGET, KEY, 16)


@query("class_percent_after_sampling", with_(LINES, """SELECT step, conversion_target, n,
  round(100.0 * n / sum(n) OVER (PARTITION BY step), 6) AS percent FROM (
  SELECT 'oversampled' AS step, conversion_target, count(*) * CASE conversion_target
    WHEN 1 THEN 10 ELSE 1 END AS n FROM lines GROUP BY 2
  UNION ALL SELECT 'undersampled', conversion_target, (SELECT count(*) FROM lines
    WHERE conversion_target = 1) FROM lines GROUP BY 2)"""))
def class_percent_after_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base(spark, sf_dir)
    parts = [sample.class_percent(rows, TARGET).withColumn("step", F.lit(step)) for step, rows in
             (("oversampled", sample.oversample(df, TARGET, 10)),
              ("undersampled", sample.undersample(df, TARGET, KEY)))]
    return rounded(reduce(DataFrame.unionByName, parts), ["percent"])


@query("batch_ids", with_(ranked("batch", False), """SELECT row_key,
  (k - 1) // 128 AS batch FROM ranked"""))
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.batch_ids(base(spark, sf_dir).select(KEY), KEY, 128)


@query("sliding_time_split", """WITH chunked AS (SELECT event_id, ts, least((row_number() OVER (
    ORDER BY ts, event_id) - 1) // ((SELECT count(*) FROM events) // 100), 99) AS chunk FROM events)
SELECT CAST(w AS INTEGER) AS "window", CASE WHEN chunk < 5 * w + 20 THEN 'train' ELSE 'test' END AS part,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(event_id) AS low, max(event_id) AS high
FROM chunked, range(0, 16) AS g(w) WHERE chunk >= 5 * w AND chunk < 5 * w + 25 GROUP BY 1, 2""")
def sliding_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return sample.sliding_time_split(events, ["ts", "event_id"]).groupBy("window", "part").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min("event_id").alias("low"),
        F.max("event_id").alias("high"))
