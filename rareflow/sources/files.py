"""Scans and sinks for impression tables kept as CSV, CSV.gz or Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rareflow.functions.clean import MISSING_CATEGORY, MISSING_NUMBER
from rareflow.operators.ordering import HashOrder
from rareflow.session import materialize


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Read headed CSV (plain or gzip) with an explicit schema.

    Gzip cannot be split, so a scan of fewer files than cores is spread out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(schema).option("header", True).csv(paths)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if any(f.endswith(".gz") for f in files) and len(files) < cores:
        df = df.repartition(cores)
    return df


def write_csv(df: DataFrame, path: str, compression: str = "none",
              partition_by: Sequence[str] = ()) -> str:
    writer = df.write.option("header", True).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def write_each(df: DataFrame, column: str, values: Sequence[str],
               work: Callable[[DataFrame], DataFrame], path: str) -> str:
    """The rows of each value, worked on, as a Parquet folder ``column=value``, one after the other.

    A partitioned write of all of them sorts a task's finished rows by the column first, which takes
    memory for all of a task's rows; here they are written as they come. Other values are an error.
    """
    other = df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False))).limit(1)
    if not other.isEmpty():
        raise ValueError(f"{column} has values other than {list(values)}")
    for value in values:
        rows = work(df.filter(F.col(column) == value))
        rows.drop(column).write.parquet(f"{path}/{column}={value}")
    return path


def with_path_class(df: DataFrame, name: str = "path_class") -> DataFrame:
    """Class named in the file path: ``positive``, ``negative`` or NULL."""
    path = F.col("_metadata.file_path")
    return df.select(
        "*",
        F.when(path.contains("positive"), F.lit("positive"))
        .when(path.contains("negative"), F.lit("negative")).alias(name))


def read_class(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Only the files of one class from ``class=`` directories (partition pruning)."""
    return spark.read.parquet(path).filter(F.col("class") == value)


def schema_report(sources: Mapping[str, DataFrame], expected: Sequence[str]) -> DataFrame:
    """(source, column, present, non_null) for every source and column known."""
    known = sorted(set(expected).union(*[df.columns for df in sources.values()]))
    parts = []
    for name, df in sources.items():
        counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias(c)
                          for c in known])
        parts.append(
            counts.unpivot([], known, "column", "non_null")
            .select(F.lit(name).alias("source"), "column",
                    F.col("column").isin(df.columns).cast("int").alias("present"), "non_null"))
    return reduce(DataFrame.unionByName, parts)


def check_schema(sources: Mapping[str, DataFrame], categorical: Sequence[str],
                 numeric: Sequence[str]) -> None:
    """Raise ValueError unless all headers agree with each other and the metadata."""
    headers = {name: df.columns for name, df in sources.items()}
    first = next(iter(headers.values()))
    for name, header in headers.items():
        if header != first:
            raise ValueError(f"columns of {name} differ from those of the first source")
    if sorted([*categorical, *numeric]) != sorted(first):
        raise ValueError("vocabulary and statistics columns do not match the header")


def fill_defaults(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Missing categories become '-1', missing numbers 0."""
    return df.na.fill({**{c: MISSING_CATEGORY for c in categorical},
                       **{c: MISSING_NUMBER for c in numeric}})


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables, keeping only the columns all of them have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*common) for f in frames])


def with_split(df: DataFrame, key: Column | str, name: str = "split") -> DataFrame:
    """80/10/10 train, validation, test by the first byte of a keyed hash."""
    key = F.col(key) if isinstance(key, str) else key
    # a column of its own: within the cases the hash, and the key, would be made anew for each
    byte = F.col("__byte")
    hashed = df.withColumn(
        "__byte", F.substring(F.md5(F.concat(F.lit("split:"), key).cast("binary")), 1, 2))
    return hashed.withColumn(
        name, F.when(byte <= "cc", F.lit("train")).when(byte <= "e5", F.lit("validation"))
        .otherwise(F.lit("test"))).drop("__byte")


ROWS_PER_FILE = 2_000_000


def with_shard(df: DataFrame, key: Column | str, num_shards: int, seed: str = "shard",
               by: str | None = None, position: str | None = None, piece: str | None = None,
               rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``shard`` column: consecutive pieces of n // num_shards rows in key order
    within each value of ``by``; the remainder goes to shard ``num_shards``.

    With fewer rows than shards every row is remainder. ``position`` names a column
    to keep the row's place in the order, for which all rows are shuffled and ranked; ``piece`` one to
    number stretches of about ``rows_per_file`` consecutive rows, for which none is.
    """
    order = HashOrder(df, key, seed, by)
    per = {g: n // num_shards for g, n in order.counts().items()}
    if not position:
        return order.passed({g: [size * (s + 1) for s in range(num_shards)]
                             for g, size in per.items()}, "shard", piece, rows_per_file)
    sizes = df.sparkSession.createDataFrame(
        list(per.items()), f"__g {order.rows.schema['__group'].dataType.simpleString()}, __size bigint")
    group = F.col(by) if by else F.lit(0)
    shard = F.when(F.col("__size") > 0, F.least(
        F.floor(F.col(position) / F.col("__size")), F.lit(num_shards))).otherwise(num_shards)
    return (order.positions(position).join(sizes, group.eqNullSafe(F.col("__g")))
            .withColumn("shard", shard.cast("int")).drop("__g", "__size"))


def with_ordered_shard(df: DataFrame, order: Sequence[str], num_shards: int) -> DataFrame:
    """``shard`` column: consecutive pieces of n // num_shards rows in the order of the given
    columns, as a file is cut as it lies; the remainder goes to shard ``num_shards``.

    Rows are range-partitioned; partition sizes give the offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = materialize(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()),
                       "ordered")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)   # per partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
                           F.sum("__n").over(Window.partitionBy()).alias("__all"))
    # content orders rows that tie
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c not in order]
    place = F.col("__start") + F.row_number().over(
        Window.partitionBy("__part").orderBy(*keys, *rest)) - 1
    size = F.floor(F.col("__all") / num_shards)
    shard = F.when(size > 0, F.least(F.floor(place / size), F.lit(num_shards))).otherwise(num_shards)
    return rows.join(starts, "__part").withColumn("shard", shard.cast("int")).select(
        *df.columns, "shard")


def write_shards(df: DataFrame, path: str, position: str | None = None,
                 rows_per_file: int = ROWS_PER_FILE, piece: str | None = None) -> str:
    """One directory per shard; a shard's files hold consecutive rows, so neither a
    large shard nor a repeated key ends up in one task. The rows are cut by their ``position``
    or come with the ``piece`` they belong to."""
    cut = F.col(piece) if piece else F.floor(F.col(position) / rows_per_file)
    df.repartition("shard", cut).drop(piece or position).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, shards: Sequence[int],
                key: str) -> DataFrame:
    """Only the chosen shards (partition pruning), in shard order."""
    return (spark.read.parquet(path).filter(F.col("shard").isin(list(shards)))
            .orderBy("shard", key))


def save_metadata(vocabulary: DataFrame, stats: DataFrame, cardinality: DataFrame,
                  path: str) -> str:
    vocabulary.write.parquet(f"{path}/vocabulary")
    stats.write.parquet(f"{path}/stats")
    cardinality.write.parquet(f"{path}/cardinality")
    return path


def load_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{part}")
                 for part in ("vocabulary", "stats", "cardinality"))


def stats_json(stats: DataFrame) -> str:
    """{column: {mean, std}} (one entry per column: metadata)."""
    return json.dumps({r["column"]: {"mean": r["mean"], "std": r["std"]}
                       for r in stats.collect()}, indent=2, sort_keys=True)


def cardinality_json(cardinality: DataFrame) -> str:
    """{position: cardinality}; JSON turns the positions into text keys."""
    return json.dumps({str(r["position"]): r["cardinality"] for r in cardinality.collect()},
                      sort_keys=True)


def read_metadata_json(spark: SparkSession, vocabulary: str | None = None,
                       stats: str | None = None, cardinality: str | None = None) -> dict:
    """Metadata JSON texts -> tables; text positions become integers again."""
    out = {}
    if vocabulary is not None:
        rows = [(c, str(v), i) for c, vs in json.loads(vocabulary).items()
                for i, v in enumerate(vs)]
        out["vocabulary"] = spark.createDataFrame(rows, "column string, value string, idx bigint")
    if stats is not None:
        rows = [(c, float(s["mean"]), float(s["std"])) for c, s in json.loads(stats).items()]
        out["stats"] = spark.createDataFrame(rows, "column string, mean double, std double")
    if cardinality is not None:
        rows = [(int(p), int(n)) for p, n in json.loads(cardinality).items()]
        out["cardinality"] = spark.createDataFrame(rows, "position int, cardinality bigint")
    return out


def load_matrix(df: DataFrame, features: Sequence[str], target: str,
                keep: Sequence[str] = ()) -> DataFrame:
    """Features as one array column, the label as 0/1 and as an indicator pair."""
    y = F.col(target).cast("int")
    return df.select(
        *keep, F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
        y.alias("label"), F.array(1 - y, y).alias("label_pair"))


def append_results(results: DataFrame, path: str, run_id: str) -> str:
    """Append a small result table under its run id."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id") \
        .parquet(path)
    return path
