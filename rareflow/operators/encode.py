"""Fitted encoders. Everything fitted is a small table or literal; applying it is
one projection plus, for large vocabularies, dictionary joins."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rareflow.functions.clean import MISSING_CATEGORY, MISSING_NUMBER
from rareflow.operators.clean import FeatureSpec, impute, order_columns
from rareflow.operators.profile import (
    numeric_stats, ranked_values, value_counts, whole_columns)

BROADCAST_BYTES = 64 << 20   # dictionaries up to this measured size are broadcast
LEVEL_LIMIT = 1_000          # levels a one-hot projection may have
HEAVY_VALUES = 1_000         # most frequent values coded by broadcast in a big lookup
SALTS = 1_024
MOST_PARTITIONS = 1 << 30


@dataclass(frozen=True)
class Size:
    """Entries and bytes of one column's dictionary."""

    entries: int = 0
    bytes: int = 0


def dictionary_sizes(vocabulary: DataFrame) -> dict[str, Size]:
    """Measured size per column (metadata: one row per column)."""
    rows = vocabulary.groupBy("column").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value") + 24).alias("bytes")).collect()
    return {r["column"]: Size(r["n"], r["bytes"]) for r in rows}


def dictionary_join(df: DataFrame, dictionary: DataFrame, column: str, payload: str, out: str,
                    size: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left lookup of ``column`` in the distinct ``value``s of ``dictionary``; NULL
    where it has no entry.

    ``size`` is the dictionary's measured size in bytes. Beyond
    ``broadcast_bytes`` it is shuffled, but the most frequent
    values are looked up by broadcast first, so no task receives all rows of a hot
    value. Frequencies come from the dictionary's ``n``, else from the rows.
    """
    codes = dictionary.select(F.col("value").alias("__value"), F.col(payload).alias(out))
    if size <= broadcast_bytes:
        return df.join(F.broadcast(codes), F.col(column) == F.col("__value"), "left") \
            .drop("__value")
    if "n" in dictionary.columns:
        heavy = dictionary.orderBy(F.desc("n"), "value").limit(HEAVY_VALUES)
    else:
        often = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")) \
            .orderBy(F.desc("n"), "value").limit(HEAVY_VALUES)
        heavy = dictionary.join(F.broadcast(often), "value")
    heavy = heavy.select(F.col("value").alias("__value"), F.col(payload).alias("__heavy"))
    first = df.join(F.broadcast(heavy), F.col(column) == F.col("__value"), "left") \
        .drop("__value")
    # rows already coded (or null) must not meet in one task: give them spread keys
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("string"))
    probe = F.when(F.col("__heavy").isNull() & F.col(column).isNotNull(),
                   F.col(column).cast("string")).otherwise(salt)
    joined = first.withColumn("__probe", probe).join(
        codes, F.col("__probe") == F.col("__value").cast("string"), "left")
    return joined.withColumn(out, F.coalesce("__heavy", out)).drop("__heavy", "__probe", "__value")


def encode_codes(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str],
                 unseen: str = "error", suffix: str = "", sizes: Mapping[str, Size] | None = None,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Codes of categorical columns, as ``<column><suffix>``.

    ``unseen``: ``error`` raises when a row is read, ``oov`` gives the code after
    the last one, ``missing`` gives -1.
    """
    sizes = sizes or dictionary_sizes(vocabulary)
    whole = whole_columns(df, columns) if dict(vocabulary.dtypes)["value"] == "string" else []
    for column in columns:
        size = sizes.get(column, Size())
        dictionary = vocabulary.filter(F.col("column") == column).drop("column")
        if column in whole:   # numbers are looked up as numbers; a text that is none matches nothing
            number = F.col("value").try_cast("bigint")
            dictionary = dictionary.filter(number.cast("string") == F.col("value")).withColumn(
                "value", number)
        df = dictionary_join(df, dictionary, column, "idx", "__code", size.bytes,
                             broadcast_bytes)
        if unseen == "error":
            message = F.concat(F.lit(f"unseen value in column {column}: "),
                               F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
            fallback = F.raise_error(message).cast("bigint")
        elif unseen == "oov":
            fallback = F.lit(size.entries).cast("bigint")
        else:
            fallback = F.lit(-1).cast("bigint")
        df = df.withColumn(f"{column}{suffix}", F.coalesce("__code", fallback)).drop("__code")
    return df


def hash_encode(df: DataFrame, columns: Sequence[str], buckets: int, suffix: str = "_hash"
                ) -> DataFrame:
    """Category text -> one of ``buckets`` numbers by hash: no vocabulary, no unseen values.

    A missing value hashes like the missing category.
    """
    def code(c: str) -> Column:
        text = F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
                % buckets).cast("int")

    return df.withColumns({f"{c}{suffix}": code(c) for c in columns})


def column_levels(vocabulary: DataFrame, columns: Sequence[str], limit: int = LEVEL_LIMIT
                  ) -> dict[str, list[str]]:
    """Levels per column in code order; refuses columns with many levels."""
    sizes = dictionary_sizes(vocabulary)
    wide = {c: sizes[c].entries for c in columns if c in sizes and sizes[c].entries > limit}
    if wide:
        raise ValueError(f"too many levels for one-hot columns: {wide}")
    rows = vocabulary.filter(F.col("column").isin(list(columns))).orderBy("column", "idx").collect()
    return {c: [r["value"] for r in rows if r["column"] == c] for c in columns}


def with_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], unseen: str = "error"
                ) -> DataFrame:
    """The place (from 1) of each value among its column's levels, in place of the value; 0 if it
    is none of them, or an error. A value is looked up once, not compared once per indicator."""
    places = {}
    for column, values in levels.items():
        if not values:
            continue
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column).cast("string"))
        if unseen == "error":
            place = F.when(place > 0, place).otherwise(F.raise_error(
                f"unseen value in column {column}").cast("bigint"))
        places[column] = F.coalesce(place, F.lit(0)).cast("int")
    return df.withColumns(places)


def onehot_columns(levels: Mapping[str, Sequence[str]]) -> list[Column]:
    """Indicator columns ``<feature>_<i>``, i = rank of the level, behind ``with_levels``."""
    return [(F.col(column) == i + 1).cast("int").alias(f"{column}_{i}")
            for column, values in levels.items() for i in range(len(values))]


def onehot_expand(df: DataFrame, levels: Mapping[str, Sequence[str]], unseen: str = "error"
                  ) -> DataFrame:
    keep = [c for c in df.columns if c not in levels]
    return with_levels(df, levels, unseen).select(*keep, *onehot_columns(levels))


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing category -> -1; whole numbers stay numbers, other categories become text."""
    whole = whole_columns(df, columns)
    return impute(df, [c for c in columns if c not in whole]).withColumns(
        {c: F.coalesce(F.col(c).cast("bigint"), F.lit(int(MISSING_CATEGORY))) for c in whole})


def stats_map(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """{column: (mean, std)} (metadata: one row per column)."""
    return {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}


def scaled(column: str, stats: Mapping[str, tuple[float, float]]) -> Column:
    """(x - mean) / std, a zero or unknown std counting as 1; nulls stay null."""
    mean, std = stats[column]
    return (F.col(column) - F.lit(mean or 0.0)) / F.lit(std or 1.0)


def standard_scale(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                   columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scaled(c, stats) for c in columns})


def scale_then_impute(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                      columns: Sequence[str]) -> DataFrame:
    """Scale, then missing -> 0, which is imputation by the mean."""
    return df.withColumns({c: F.coalesce(scaled(c, stats), F.lit(MISSING_NUMBER))
                           for c in columns})


def default_then_scale(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                       columns: Sequence[str]) -> DataFrame:
    """Batch-reader order: missing -> 0 first, then standardise from the stats map."""
    filled = df.na.fill({c: MISSING_NUMBER for c in columns})
    return standard_scale(filled, stats, columns)


def as_nominal(df: DataFrame, column: str, size: int) -> DataFrame:
    """Declare the number of codes, so that one-hot fitting needs no pass over the rows."""
    return df.withColumn(column, F.col(column).cast("double")).withMetadata(
        column, {"ml_attr": {"type": "nominal", "num_vals": size, "name": column}})


def assemble_sparse(df: DataFrame, vocabulary: DataFrame, stats: Mapping[str, tuple[float, float]],
                    categorical: Sequence[str], numeric: Sequence[str], out: str = "features"
                    ) -> DataFrame:
    """Sparse vector: an indicator block of vocabulary + 1 slots per category (last
    slot: out of vocabulary), then the scaled numbers."""
    sizes = dictionary_sizes(vocabulary)
    codes = [f"{c}__idx" for c in categorical]
    blocks = [f"{c}__hot" for c in categorical]
    coded = encode_codes(df, vocabulary, categorical, "oov", "__idx", sizes)
    for column, code in zip(categorical, codes):
        coded = as_nominal(coded, code, sizes.get(column, Size()).entries + 1)
    coded = default_then_scale(coded, stats, numeric)
    hot = OneHotEncoder(inputCols=codes, outputCols=blocks, dropLast=False).fit(coded) \
        .transform(coded)
    return VectorAssembler(inputCols=[*blocks, *numeric], outputCol=out).transform(hot) \
        .drop(*codes, *blocks)


# -- the whole preparation as one estimator ------------------------------------


class FeatureEncoder(Estimator):
    """Drop, scale, impute, index- and one-hot-encode, order the columns.

    Vocabularies come from all rows given to ``fit`` (an unseen value later is an
    error) or, with ``unseen='oov'``, from the training rows; scaling always uses
    the training rows, selected by the SQL condition ``train``.
    """

    def __init__(self, spec: FeatureSpec, train: str = "true", unseen: str = "error",
                 keep: Sequence[str] = (), level_limit: int = LEVEL_LIMIT):
        super().__init__()
        self.spec, self.train, self.unseen, self.keep = spec, train, unseen, list(keep)
        self.level_limit = level_limit

    def _fit(self, dataset: DataFrame) -> FeatureEncoderModel:
        spec = self.spec
        train = dataset.filter(F.expr(self.train))
        source = dataset if self.unseen == "error" else train
        filled = categories(source.select(*spec.categorical), spec.categorical)
        whole = whole_columns(filled, spec.categorical)
        text = [c for c in spec.categorical if c not in whole]
        # a pass over the numbers and one over the texts: each reads only its columns
        counts = [value_counts(filled, columns) for columns in (whole, text) if columns]
        vocabulary = ranked_values(reduce(DataFrame.unionByName, counts))
        stats = stats_map(numeric_stats(train, spec.continuous)) if spec.continuous else {}
        levels = column_levels(vocabulary, spec.onehot, self.level_limit)
        return FeatureEncoderModel(spec, vocabulary, levels, stats, self.unseen, self.keep)


class FeatureEncoderModel(Model):
    """Fitted vocabularies, levels and statistics."""

    def __init__(self, spec: FeatureSpec, vocabulary: DataFrame, levels: dict[str, list[str]],
                 stats: dict[str, tuple[float, float]], unseen: str, keep: Sequence[str]):
        super().__init__()
        self.spec, self.vocabulary, self.levels = spec, vocabulary, levels
        self.stats, self.unseen, self.keep = stats, unseen, list(keep)
        self.sizes = dictionary_sizes(vocabulary)

    @property
    def output_columns(self) -> list[str]:
        hot = [f"{c}_{i}" for c, v in self.levels.items() for i in range(len(v))]
        return sorted([*hot, *self.spec.index, *self.spec.continuous])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec = self.spec
        coded = categories(dataset, spec.categorical)
        coded = encode_codes(coded, self.vocabulary, spec.index, self.unseen, sizes=self.sizes)
        # the indicators are a step of their own: Spark makes one Java method of all steps in a row, and
        # one beyond 8,000 bytes is never compiled; as many partitions as before come out of this
        coded = with_levels(coded, self.levels, self.unseen).coalesce(MOST_PARTITIONS)
        numbers = [F.coalesce(scaled(c, self.stats), F.lit(MISSING_NUMBER)).alias(c)
                   for c in spec.continuous]
        wide = coded.select(*self.keep, *spec.index, *numbers,
                            *onehot_columns(self.levels),
                            *([spec.target] if spec.target in dataset.columns else []))
        if spec.target not in wide.columns:
            return wide.select(*self.keep, *self.output_columns)
        ordered = order_columns(wide.drop(*self.keep), spec.target).columns
        return wide.select(*self.keep, *ordered)

    def save(self, path: str) -> None:
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        meta = {"spec": self.spec.__dict__, "stats": self.stats, "unseen": self.unseen,
                "keep": self.keep, "levels": self.levels}
        spark = self.vocabulary.sparkSession
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureEncoderModel:
        meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
        stats = {c: tuple(v) for c, v in meta["stats"].items()}
        return FeatureEncoderModel(
            FeatureSpec(**meta["spec"]), spark.read.parquet(f"{path}/vocabulary"), meta["levels"],
            stats, meta["unseen"], meta["keep"])


def index_cardinality(profile: DataFrame, index: Sequence[str], output_columns: Sequence[str]
                      ) -> DataFrame:
    """(position, column, cardinality + 1) of the index features; the extra slot
    is for missing values."""
    position = F.lit(None).cast("int")
    for column in index:
        position = F.when(F.col("column") == column,
                          F.lit(list(output_columns).index(column))).otherwise(position)
    return profile.filter(F.col("column").isin(list(index))).select(
        position.alias("position"), "column", (F.col("cardinality") + 1).alias("cardinality"))


# -- embeddings ------------------------------------------------------------------


def embedding_dim(cardinality: Column, alpha: float = 3.0) -> Column:
    """ceil(cardinality ^ (1 / alpha)), safe at perfect powers."""
    return F.ceil(F.pow(cardinality.cast("double"), F.lit(1.0 / alpha)) - F.lit(1e-9)).cast("int")


def embedding_dims(cardinalities: DataFrame, alpha: float = 3.0) -> DataFrame:
    return cardinalities.withColumn("dim", embedding_dim(F.col("cardinality"), alpha))


def embedded_width(cardinalities: DataFrame, num_inputs: int, alpha: float = 3.0) -> DataFrame:
    """Width after embedding: inputs - categorical + sum of dims."""
    return embedding_dims(cardinalities, alpha).agg(
        (F.lit(num_inputs) - F.count("*") + F.sum("dim")).cast("bigint").alias("embedded_width"))


def onehot_width(vocabulary: DataFrame, numeric: int) -> DataFrame:
    """Width of the one-hot form: sum of (levels + 1) plus the numeric columns."""
    sizes = vocabulary.groupBy("column").agg(F.count_distinct("value").alias("n"))
    return sizes.agg((F.sum(F.col("n") + 1) + F.lit(numeric)).cast("bigint")
                     .alias("onehot_width"))


def embedding_lookup(df: DataFrame, embeddings: DataFrame, numeric: Sequence[str],
                     index: Sequence[str], out: str = "embedded",
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Numeric columns first, then the embedding row of each code, in given order.

    ``embeddings`` is (column, code, vector); an absent code is an error.
    """
    measured = embeddings.groupBy("column").agg(F.sum(F.size("vector") * 8 + 24).alias("bytes"))
    sizes = {r["column"]: r["bytes"] for r in measured.collect()}  # one row per column
    for column in index:
        rows = embeddings.filter(F.col("column") == column).select(
            F.col("code").alias("value"), "vector")
        found = f"__{column}_vector"
        df = dictionary_join(df, rows, column, "vector", found, sizes.get(column, 0),
                             broadcast_bytes)
        df = df.withColumn(found, F.coalesce(found, F.raise_error(
            f"no embedding row for a code of {column}").cast("array<double>")))
    numbers = F.array(*[F.col(c).cast("double") for c in numeric]) if numeric \
        else F.array().cast("array<double>")
    joined = F.concat(numbers, *[F.col(f"__{c}_vector") for c in index])
    return df.withColumn(out, joined).drop(*[f"__{c}_vector" for c in index])
