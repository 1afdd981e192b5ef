"""Streaming queries (I): each stream's result equals the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.models import kernel
from rareflow.models.dan import DisguiseModel, Training
from rareflow.models.kernel import Shape
from rareflow.operators import encode, profile
from rareflow.plans.encoding import SCALED, SPARSE_COLUMNS, TRAIN_STATS, train_codes, train_stats
from rareflow.plans.evaluation import ACCURACY, MICRO
from rareflow.plans.registry import LINES, SCORES, query, r, rounded, with_
from rareflow.session import materialize, scratch_path
from rareflow.sources.files import with_split, write_csv
from rareflow.sources.tables import KEY, TARGET, lines, scores
from rareflow.streaming import buffers, streams

SHARDS = 10


def shard_stream(df: DataFrame, label: str, mixed: bool = False) -> DataFrame:
    """The table as CSV shards, read one file per micro-batch.

    A table in many partitions is written as it lies: dealing its rows out anew would sort each partition and
    move every row. ``mixed`` deals them out all the same.
    """
    spark = df.sparkSession
    whole = not mixed and df.rdd.getNumPartitions() >= SHARDS
    path = write_csv(df.coalesce(SHARDS) if whole else df.repartition(SHARDS), scratch_path(spark, label))
    return streams.read_shards_stream(spark, path, df.schema)


ENCODE_SQL = "SELECT row_key, " + ", ".join(
    f"coalesce({a}.idx, (SELECT count(*) FROM vocab_{c})) AS {c}_idx"
    for a, c in (("a", "l_returnflag"), ("b", "l_suppkey"))) + ", " + ", ".join(
    f"round((coalesce({c}, 0) - {c}_m) / {c}_s, 6) + 0 AS {c}" for c in SCALED) + """
  FROM split_lines LEFT JOIN vocab_l_returnflag a ON l_returnflag = a.value
  LEFT JOIN vocab_l_suppkey b ON l_suppkey = b.value, stats"""


@query("stream_encode", with_(
    f"{TRAIN_STATS}, {train_codes('l_returnflag')}, {train_codes('l_suppkey')}", ENCODE_SQL))
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read anew for vocabulary, statistics and shards: two hashes a row cost less than a written copy
    df = with_split(lines(spark, sf_dir).select(KEY, *SPARSE_COLUMNS, *SCALED), KEY)
    vocabulary = materialize(
        profile.build_vocabulary(df.filter("split = 'train'"), SPARSE_COLUMNS), "stream-vocab")
    sizes, stats = encode.dictionary_sizes(vocabulary), train_stats(df)
    stream = shard_stream(df.drop("split"), "stream-shards")
    encoded = streams.encode_stream(stream, vocabulary, stats, SPARSE_COLUMNS, SCALED, sizes)
    return rounded(streams.write_stream(encoded, "stream-encoded"), SCALED)


@query("buffered_shuffle", with_(LINES, "SELECT row_key, conversion_target FROM lines"))
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = shard_stream(lines(spark, sf_dir).select(KEY, TARGET), "shuffle-shards")
    return streams.shuffle_stream(stream, KEY).select(KEY, TARGET)


GROUPS, FILE_ROWS = 8, 500_000


def ordered_stream(df: DataFrame, label: str) -> Callable[[], DataFrame]:
    """The table in groups by the first digit of the key, as a stream that can be opened again; a micro-batch
    reads a group's files."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    group = F.floor(F.conv(F.substring(KEY, 1, 1), 16, 10).cast("int") * GROUPS / 16).cast("int")
    rows = materialize(df.withColumn("group", group), "arriving", ["group"])
    count = max(1, -(-rows.count() // (GROUPS * FILE_ROWS)))
    for i in range(GROUPS):                      # written one after the other: read in this order
        part = rows.where(F.col("group") == i).drop("group")
        (part.repartition(count) if count > 1 else part.coalesce(1)).write.mode("append") \
            .option("header", True).csv(path)
    return lambda: streams.read_shards_stream(spark, path, df.schema, count)


def buffered_sql(size: int) -> str:
    return f"""SELECT {size} AS size, CASE WHEN after IS NULL THEN greatest(n - {size}, 0) + row_number()
    OVER (PARTITION BY after IS NULL ORDER BY md5('buffer:end:0:' || slot)) ELSE after - {size} END
    AS place, row_key, conversion_target FROM (
  SELECT *, lead(t) OVER (PARTITION BY slot ORDER BY t) AS after FROM (
    SELECT *, CASE WHEN t <= {size} THEN t - 1 ELSE CAST(('0x' || substr(md5('buffer:0:' || t), 1, 8))
      AS BIGINT) % {size} END AS slot FROM arrived))"""


ARRIVED = LINES + """, arrived AS (SELECT row_key, conversion_target, count(*) OVER () AS n,
  row_number() OVER (ORDER BY row_key) AS t FROM lines)"""


@query("shuffle_buffer", with_(ARRIVED, " UNION ALL ".join(map(buffered_sql, (1, 100)))))
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place behind a buffer of one row (none) and of 100 rows."""
    stream, found = ordered_stream(lines(spark, sf_dir).select(KEY, TARGET), "buffer-files"), []
    for size in (1, 100):
        run = buffers.shuffle_buffer(stream(), KEY, KEY, size)
        found.append(buffers.drained(run).select(F.lit(size).alias("size"), "place", KEY, TARGET))
    return found[0].unionByName(found[1])


@query("fixed_batches", with_(ARRIVED, """SELECT (t - 1) // 128 AS batch, row_key FROM arrived
  WHERE t <= n - n % 128"""))
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of exactly 128 rows, whatever the length of the files."""
    stream = ordered_stream(lines(spark, sf_dir).select(KEY, TARGET), "batch-files")
    run = buffers.fixed_batches(stream(), KEY, KEY, 128)
    return run.sent().select(F.floor((F.col("place") - 1) / 128).alias("batch"), KEY)


def line_features(df: DataFrame) -> DataFrame:
    """Four numbers per line as an array column."""
    parts = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000,
             F.coalesce("l_tax", F.lit(0.0)) * 10, (F.col("l_returnflag") == "R").cast("double")]
    return df.withColumn("features", F.array(*parts))


@query("stream_fit")
def stream_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag", TARGET]
    stream = line_features(shard_stream(lines(spark, sf_dir).select(*columns), "fit-shards", mixed=True))
    rows = stream.select("features", F.col(TARGET).alias("label"))
    model = streams.fit_stream(rows, Shape(4, (8,), (8,)), Training(),
                               scratch_path(spark, "fit-checkpoints"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.flat)],
                                 "position int, weight double")


def fixed_model() -> DisguiseModel:
    shape = Shape(4, (), batch_norm=False)
    flat = kernel.initial_weights(shape) * 0.0
    w = kernel.as_blocks(shape, flat)
    w["d0w"][:, 1] = [0.5, -0.25, 1.5, 0.75]
    w["d0b"][1] = -1.0
    return DisguiseModel(shape, flat)


@query("stream_predict", with_(LINES, """SELECT row_key, conversion_target,
  round(1 / (1 + exp(-(0.5 * l_quantity / 50 - 0.25 * l_extendedprice / 100000
  + 15 * coalesce(l_tax, 0) + 0.75 * CAST(l_returnflag = 'R' AS INTEGER) - 1))), 6) AS score
  FROM lines"""))
def stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [KEY, "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", TARGET]
    stream = line_features(shard_stream(lines(spark, sf_dir).select(*columns), "predict-shards"))
    return rounded(streams.predict_stream(stream, fixed_model(), [KEY, TARGET]), ["score"])


@query("stream_metrics", with_(f"{SCORES}, {MICRO}", f"""SELECT
  round((SELECT {ACCURACY} FROM scores), 6) AS accuracy,
  round((SELECT sum(area) FROM steps), 6) AS auroc_micro,
  (SELECT 2 * count(*) FROM scores) AS cells"""))
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = shard_stream(scores(spark, sf_dir), "score-shards")
    out = streams.stream_metrics(stream)
    return out.select(r("accuracy").alias("accuracy"), "cells",
                      r("auroc_micro").alias("auroc_micro"))
