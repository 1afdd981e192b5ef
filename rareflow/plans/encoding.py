"""Fitted encoders (D) and the dictionary join (H8)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators import clean, encode, matrix, profile
from rareflow.operators.clean import FeatureSpec
from rareflow.plans.profiling import ordered_lines, union
from rareflow.plans.registry import IMPRESSIONS, LINES, SPLIT, query, r, rounded, with_
from rareflow.session import materialize, scratch_path
from rareflow.sources.files import with_split, write_each
from rareflow.sources.tables import (
    CONTINUOUS, IGNORED, KEY, ONEHOT_AND_INDEX, TARGET, as_impressions, impressions, joined_lines,
    line_key, lines)

# Roles at the default threshold of 20 on the test tables from sf0.01 upwards.
ONEHOT = ["c_mktsegment", "l_linenumber", "l_linestatus", "l_returnflag", "o_orderpriority",
          "o_orderstatus"]
LEVELS = {"c_mktsegment": 5, "l_linenumber": 7, "l_linestatus": 2, "l_returnflag": 3,
          "o_orderpriority": 5, "o_orderstatus": 3}
INDEX = ["c_nationkey", "l_partkey", "l_suppkey"]
SPEC = FeatureSpec(IGNORED, sorted(CONTINUOUS), ONEHOT, INDEX, TARGET)


def rank_sql(column: str) -> str:
    """Code of a category: rank of its text (missing as '-1')."""
    return f"dense_rank() OVER (ORDER BY coalesce({column}, '-1')) - 1"


@query("index_encode", with_(LINES, f"""SELECT row_key, {rank_sql('l_suppkey')} AS l_suppkey,
  {rank_sql('l_partkey')} AS l_partkey FROM lines"""))
def index_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_suppkey", "l_partkey"]
    df = lines(spark, sf_dir).select(KEY, *columns)
    return encode.encode_codes(df, profile.build_vocabulary(df, columns), columns)


@query("onehot_expand", with_(LINES + f""", coded AS (SELECT row_key,
  {rank_sql('l_returnflag')} AS f, {rank_sql('l_linestatus')} AS s FROM lines)""",
    """SELECT row_key, CAST(f = 0 AS INTEGER) AS l_returnflag_0,
  CAST(f = 1 AS INTEGER) AS l_returnflag_1, CAST(f = 2 AS INTEGER) AS l_returnflag_2,
  CAST(s = 0 AS INTEGER) AS l_linestatus_0, CAST(s = 1 AS INTEGER) AS l_linestatus_1
  FROM coded"""))
def onehot_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_returnflag", "l_linestatus"]
    df = lines(spark, sf_dir).select(KEY, *columns)
    levels = encode.column_levels(profile.build_vocabulary(df, columns), columns)
    return encode.onehot_expand(df, levels)


def train_codes(column: str) -> str:
    """Vocabulary of the training rows with codes, and its size, as CTEs."""
    return f"""vocab_{column} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
  FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS value FROM split_lines
    WHERE split = 'train'))"""


OOV = f"{LINES}, {SPLIT}, {train_codes('l_orderkey')}, {train_codes('l_returnflag')}"


@query("onehot_vector_oov", with_(OOV, """SELECT row_key,
  coalesce(o.idx, (SELECT count(*) FROM vocab_l_orderkey)) AS l_orderkey_idx,
  coalesce(f.idx, (SELECT count(*) FROM vocab_l_returnflag)) AS l_returnflag_idx
  FROM split_lines LEFT JOIN vocab_l_orderkey o ON CAST(l_orderkey AS VARCHAR) = o.value
  LEFT JOIN vocab_l_returnflag f ON l_returnflag = f.value"""))
def onehot_vector_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of the indicator vector; the last slot is out-of-vocabulary."""
    columns = ["l_orderkey", "l_returnflag"]
    df = ordered_lines(spark, sf_dir)
    vocabulary = profile.build_vocabulary(df.filter("split = 'train'"), columns)
    return encode.encode_codes(df, vocabulary, columns, "oov", "_idx").select(
        KEY, "l_orderkey_idx", "l_returnflag_idx")


SCALED = ["l_quantity", "l_extendedprice", "l_tax"]
TRAIN_STATS = LINES + ", " + SPLIT + ", stats AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SCALED) \
    + " FROM split_lines WHERE split = 'train')"


def train_stats(df: DataFrame) -> dict:
    return encode.stats_map(profile.numeric_stats(df.filter("split = 'train'"), SCALED))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(lines(spark, sf_dir).select(KEY, *SCALED), KEY)


def scaled_sql(form: str) -> str:
    cells = ", ".join(f"round({form.format(c=c)}, 6) + 0 AS {c}" for c in SCALED)
    return f"SELECT row_key, {cells} FROM split_lines, stats"


@query("standard_scale", with_(TRAIN_STATS, scaled_sql("({c} - {c}_m) / {c}_s")))
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_lines(spark, sf_dir)
    return rounded(encode.standard_scale(df, train_stats(df), SCALED), SCALED).drop("split")


@query("scale_then_impute", with_(TRAIN_STATS, scaled_sql("coalesce(({c} - {c}_m) / {c}_s, 0)")))
def scale_then_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_lines(spark, sf_dir)
    return rounded(encode.scale_then_impute(df, train_stats(df), SCALED), SCALED).drop("split")


@query("batch_standardize", with_(TRAIN_STATS, scaled_sql("(coalesce({c}, 0) - {c}_m) / {c}_s")))
def batch_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_lines(spark, sf_dir)
    return rounded(encode.default_then_scale(df, train_stats(df), SCALED), SCALED).drop("split")


ENCODED = f"""{IMPRESSIONS}, train AS (SELECT * FROM impressions
  WHERE substr(md5('split:' || row_key), 1, 2) <= 'cc'),
stats AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s"
                            for c in CONTINUOUS)} FROM train),
coded AS (SELECT row_key, conversion_target, {", ".join(CONTINUOUS)},
  {", ".join(f"{rank_sql(c)} AS {c}" for c in ONEHOT_AND_INDEX)} FROM impressions)"""
ENCODED_COLUMNS = ", ".join(
    [*INDEX, *[f"round(coalesce(({c} - {c}_m) / {c}_s, 0), 6) + 0 AS {c}" for c in CONTINUOUS],
     *[f"CAST({c} = {i} AS INTEGER) AS {c}_{i}" for c, n in LEVELS.items() for i in range(n)]])


def encoder_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, encode.FeatureEncoderModel]:
    # written once: the join would run again for vocabularies, statistics and encoding; written as the
    # tables hold it: a key is twice as long as all numbers it is made of
    joined = with_split(joined_lines(spark, sf_dir), line_key(F.col("cents")))
    df = as_impressions(materialize(clean.normalize_missing(joined), "impressions"), "split",
                        text=False)
    encoder = encode.FeatureEncoder(SPEC, "split = 'train'", keep=[KEY, "split"])
    return df, encoder.fit(df)


@query("feature_encoding", with_(ENCODED, f"""SELECT row_key, {ENCODED_COLUMNS}, conversion_target
  FROM coded, stats"""))
def feature_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = encoder_model(spark, sf_dir)
    return rounded(model.transform(df), CONTINUOUS).drop("split")


@query("write_processed", with_(ENCODED, f"""SELECT CASE WHEN substr(md5('split:' || row_key), 1, 2)
  <= 'cc' THEN 'train' WHEN substr(md5('split:' || row_key), 1, 2) <= 'e5' THEN 'validation'
  ELSE 'test' END AS split, count(*) AS n, CAST(sum(conversion_target) AS BIGINT) AS positives,
  {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in INDEX)},
  {", ".join(f"round(sum(coalesce(({c} - {c}_m) / {c}_s, 0)), 4) + 0 AS {c}" for c in CONTINUOUS)},
  {", ".join(f"CAST(sum(CAST({c} = {i} AS INTEGER)) AS BIGINT) AS {c}_{i}"
             for c, n in LEVELS.items() for i in range(n))} FROM coded, stats GROUP BY 1"""))
def write_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, model = encoder_model(spark, sf_dir)
    read = spark.read.parquet(write_each(df, "split", ["train", "validation", "test"], model.transform,
                                         scratch_path(spark, "processed")))
    whole = [c for c in model.output_columns if c not in CONTINUOUS]
    return read.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(TARGET).alias("positives"),
        *[F.sum(c).alias(c) for c in whole], *[r(F.sum(c), 4).alias(c) for c in CONTINUOUS])


OUTPUT = [*INDEX, *sorted(CONTINUOUS), *[f"{c}_{i}" for c, n in LEVELS.items() for i in range(n)]]


@query("index_cardinality", with_(IMPRESSIONS, union(
    f"""SELECT {sorted(OUTPUT).index(c)} AS position, '{c}' AS "column",
  count(DISTINCT {c}) + 1 AS cardinality FROM impressions""" for c in INDEX)))
def index_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir)
    _, model = encoder_model(spark, sf_dir)
    return encode.index_cardinality(profile.cardinality_profile(df, INDEX), INDEX,
                                    model.output_columns)


@query("category_codes", with_(IMPRESSIONS + """, vocab AS (SELECT o_orderpriority AS value,
  row_number() OVER (ORDER BY o_orderpriority) - 1 AS idx FROM (SELECT DISTINCT o_orderpriority
  FROM impressions WHERE o_orderpriority IS NOT NULL))""", """SELECT row_key,
  coalesce(idx, -1) AS o_orderpriority FROM impressions
  LEFT JOIN vocab ON o_orderpriority = value"""))
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir).select(KEY, "o_orderpriority")
    vocabulary = profile.build_vocabulary(df, ["o_orderpriority"])
    return encode.encode_codes(df, vocabulary, ["o_orderpriority"], "missing")


DIM = "CAST(ceil(pow(cardinality, 1 / CAST(3 AS DOUBLE)) - 1e-9) AS INTEGER)"
CARDINALITIES = IMPRESSIONS + ", cards AS (" + union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + 1 AS cardinality FROM impressions"
    for c in INDEX) + ")"


@query("embedding_dims", with_(CARDINALITIES + f""", dims AS (SELECT "column", cardinality,
  {DIM} AS dim FROM cards)""", f"""SELECT *, (SELECT CAST({len(OUTPUT)} - count(*) + sum(dim)
  AS BIGINT) FROM dims) AS embedded_width, (SELECT CAST(sum(n + 1) + {len(CONTINUOUS)} AS BIGINT)
  FROM ({union(f"SELECT count(DISTINCT {c}) AS n FROM impressions" for c in ONEHOT_AND_INDEX)}))
  AS onehot_width FROM dims"""))
def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impressions(spark, sf_dir)
    cards = profile.cardinality_profile(df, INDEX).withColumn(
        "cardinality", F.col("cardinality") + 1)
    vocabulary = profile.value_counts(df, ONEHOT_AND_INDEX)
    return encode.embedding_dims(cards).withColumn(
        "embedded_width", encode.embedded_width(cards, len(OUTPUT)).scalar()).withColumn(
        "onehot_width", encode.onehot_width(vocabulary, len(CONTINUOUS)).scalar())


EMBEDDED_DIMS = {"c_nationkey": 3, "l_suppkey": 5}


def fixed_embeddings(vocabulary: DataFrame) -> DataFrame:
    """(column, code, vector) with given numbers in place of trained ones."""
    width = F.when(F.col("column") == "c_nationkey", 3).otherwise(5)
    return vocabulary.select(
        "column", F.col("idx").alias("code"),
        F.transform(F.sequence(F.lit(0), width - 1),
                    lambda i: F.pmod(F.col("idx") * 7 + i * 3, F.lit(11)) / 10.0).alias("vector"))


EMBED = IMPRESSIONS + f""", coded AS (SELECT row_key, l_quantity, o_totalprice,
  {rank_sql('c_nationkey')} AS c_nationkey, {rank_sql('l_suppkey')} AS l_suppkey FROM impressions),
embedded AS (SELECT row_key, 0 AS pos, l_quantity AS value FROM coded
  UNION ALL SELECT row_key, 1, o_totalprice FROM coded
  UNION ALL SELECT row_key, CAST(2 + i AS INTEGER), ((c_nationkey * 7 + i * 3) % 11)
    / CAST(10 AS DOUBLE) FROM coded, range(0, 3) AS g(i)
  UNION ALL SELECT row_key, CAST(5 + i AS INTEGER), ((l_suppkey * 7 + i * 3) % 11)
    / CAST(10 AS DOUBLE) FROM coded, range(0, 5) AS g(i))"""


def embedded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = list(EMBEDDED_DIMS)
    df = impressions(spark, sf_dir).select(KEY, "l_quantity", "o_totalprice", *columns)
    vocabulary = materialize(profile.build_vocabulary(df, columns), "codes")
    coded = encode.encode_codes(df, vocabulary, columns)
    return encode.embedding_lookup(coded, fixed_embeddings(vocabulary),
                                   ["l_quantity", "o_totalprice"], columns)


@query("embedding_lookup", with_(EMBED, """SELECT pos, count(*) AS n, round(sum(value), 2) AS total,
  round(min(value), 6) AS min, round(max(value), 6) AS max FROM embedded GROUP BY 1"""))
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cells(embedded_rows(spark, sf_dir), [KEY], "embedded").groupBy("pos").agg(
        F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"),
        r(F.min("value")).alias("min"), r(F.max("value")).alias("max"))


@query("embedded_feature_rollup", with_(EMBED + """, names AS (SELECT * FROM (VALUES
  (0, 'l_quantity', 'l_quantity'), (1, 'o_totalprice', 'o_totalprice'),
  (2, 'c_nationkey', 'c_nationkey_emb_0'), (3, 'c_nationkey', 'c_nationkey_emb_1'),
  (4, 'c_nationkey', 'c_nationkey_emb_2'), (5, 'l_suppkey', 'l_suppkey_emb_0'),
  (6, 'l_suppkey', 'l_suppkey_emb_1'), (7, 'l_suppkey', 'l_suppkey_emb_2'),
  (8, 'l_suppkey', 'l_suppkey_emb_3'), (9, 'l_suppkey', 'l_suppkey_emb_4'))
  AS t(pos, "column", name))""", """SELECT pos, "column", name,
  round(round(sum(value), 6) / count(*), 6) AS mean_shift, count(*) AS n FROM embedded JOIN names USING (pos) GROUP BY 1, 2, 3"""))
def embedded_feature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("l_quantity", 1, False), ("o_totalprice", 1, False),
             *[(c, n, True) for c, n in EMBEDDED_DIMS.items()]]
    dims = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)],
                                 "position int, column string, dim int, embedded boolean")
    offsets = matrix.embedded_offsets(dims)
    return rounded(matrix.feature_rollup(embedded_rows(spark, sf_dir), "embedded", offsets),
                   ["mean_shift"])


SPARSE_COLUMNS = ["l_returnflag", "l_suppkey"]


def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_split(lines(spark, sf_dir).select(KEY, *SPARSE_COLUMNS, *SCALED, TARGET), KEY)
    train = df.filter("split = 'train'")
    vocabulary = profile.build_vocabulary(train, SPARSE_COLUMNS)
    return encode.assemble_sparse(df, vocabulary, train_stats(df), SPARSE_COLUMNS, SCALED)


def slot_counts(df: DataFrame) -> DataFrame:
    """(pos, n): rows with a non-zero value per slot of a sparse vector column."""
    counts = df.agg(vector_to_array(Summarizer.numNonZeros(F.col("features"))).alias("n"))
    return counts.select(F.posexplode("n").alias("pos", "n")).filter("n > 0").select(
        "pos", F.col("n").cast("bigint").alias("n"))


SPARSE = f"""{TRAIN_STATS}, {train_codes('l_returnflag')}, {train_codes('l_suppkey')},
sizes AS (SELECT (SELECT count(*) FROM vocab_l_returnflag) AS a,
  (SELECT count(*) FROM vocab_l_suppkey) AS b)"""
SPARSE_SQL = """SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n FROM (
  SELECT coalesce(idx, a) AS pos FROM lines LEFT JOIN vocab_l_returnflag ON l_returnflag = value, sizes
  UNION ALL SELECT a + 1 + coalesce(idx, b) FROM lines LEFT JOIN vocab_l_suppkey
    ON l_suppkey = value, sizes
""" + "".join(f"""  UNION ALL SELECT a + b + 2 + {i} FROM lines, sizes, stats
    WHERE coalesce({c}, 0) <> {c}_m
""" for i, c in enumerate(SCALED)) + ") GROUP BY 1"


@query("assemble_sparse", with_(SPARSE, SPARSE_SQL))
def assemble_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_counts(sparse_rows(spark, sf_dir))


@query("sparse_store", with_(SPARSE, SPARSE_SQL))
def sparse_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sparse")
    sparse_rows(spark, sf_dir).select(KEY, "features", TARGET).write.parquet(path)
    return slot_counts(spark.read.parquet(path))


@query("dictionary_join", with_(OOV, """SELECT split, count(*) AS n,
  count(*) FILTER (idx IS NULL) AS unseen,
  CAST(sum(coalesce(idx, (SELECT count(*) FROM vocab_l_orderkey))) AS BIGINT) AS codes
  FROM split_lines LEFT JOIN vocab_l_orderkey ON CAST(l_orderkey AS VARCHAR) = value GROUP BY 1"""))
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled lookup: the broadcast limit is set below the dictionary's size."""
    df = ordered_lines(spark, sf_dir).select(KEY, "l_orderkey", "split")
    vocabulary = materialize(
        profile.build_vocabulary(df.filter("split = 'train'"), ["l_orderkey"]), "dictionary")
    size = encode.dictionary_sizes(vocabulary)["l_orderkey"]
    joined = encode.dictionary_join(df, vocabulary, "l_orderkey", "idx", "code", size.bytes,
                                    broadcast_bytes=1000)
    return joined.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("unseen"),
        F.sum(F.coalesce("code", F.lit(size.entries))).alias("codes"))


HASHED = {"l_suppkey": 64, "l_partkey": 64, "l_returnflag": 64}


@query("feature_hashing", with_(LINES, "SELECT row_key, " + ", ".join(
    f"""CAST(CAST(('0x' || substr(md5('{c}=' || coalesce({c}, '-1')), 1, 12)) AS BIGINT) % {n}
  AS INTEGER) AS {c}_hash""" for c, n in HASHED.items()) + " FROM lines"))
def feature_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).select(KEY, *HASHED)
    return encode.hash_encode(df, list(HASHED), 64).drop(*HASHED)
