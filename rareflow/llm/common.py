"""Helpers shared by the training-data operators.

Rows are told apart by the integer ``doc_id``. Rows that share an id share its
decisions; rows without an id are returned but linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rareflow.session import scratch_path

BATCH_ROWS = "500"           # rows per Arrow batch: long texts must fit a worker's memory
BLOCK_MEMBERS = 64           # members that share one copy of a hub's payload

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Shelf:
    """Intermediate tables of one call, in the folder of ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, paths: Iterable[str]) -> None:
        for path in list(paths):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.paths.remove(path)

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result and delete every other table of this call."""
        before = list(self.paths)
        out = self.keep(df, label)
        self.forget(before)
        return out


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, other letters as they are; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def add_columns(df: DataFrame, extra: StructType, work) -> DataFrame:
    """``df`` with the columns of ``extra``, computed per Arrow batch by ``work(batch)``.

    ``work`` returns one array per new column. Columns of ``df`` with the same
    names are replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in extra.fields]
    base = df.drop(*names)
    schema = StructType(base.schema.fields + extra.fields)
    kept = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = work(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *names])

    return base.mapInArrow(run, schema)


def shielded(docs: DataFrame, used: Sequence[str], work: Callable[[DataFrame], DataFrame],
             added: Sequence[str] = ()) -> DataFrame:
    """``work(docs)``, which sees columns that are not ``used`` under names of no operator.

    They have their own names again afterwards, but for those named like one ``added``, which are
    replaced.
    """
    safe = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in used}
    back = {hidden: c for c, hidden in safe.items()}
    out = work(docs.withColumnsRenamed(safe))
    taken = {c.lower() for c in added}
    return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns
                        if back.get(c, "").lower() not in taken])


def star_blocks(pairs: DataFrame, payload: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Payloads of hub ``a`` and of its members ``b``, sorted for one pass.

    A hub with many members is spread over blocks of about 64 members, each with one
    copy of the hub's payload. In a block the rows of the hub come first
    (``b`` is null), so a task holds one hub and one member at a time.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("members"))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK_MEMBERS)).alias("block")
    placed = pairs.join(sizes, "a").select("a", "b", block)
    # payloads move by shuffle at every size: no side is known to stay small
    load = payload.select(F.col("id").alias("load_id"), *columns).hint("merge")
    members = placed.join(load, F.col("b") == F.col("load_id")).select("a", "block", "b", *columns)
    hubs = (placed.select("a", "block").distinct().join(load, F.col("a") == F.col("load_id"))
            .select("a", "block", F.lit(None).cast("long").alias("b"), *columns))
    small_batches(pairs.sparkSession)
    return (hubs.unionByName(members).repartition("a", "block")
            .sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()))


HOT_KEYS = 1000              # keys that a lookup broadcasts; any other has under 1/1000 of the rows


def lookup(rows: DataFrame, table: DataFrame, key: str | Sequence[str], uses: str) -> DataFrame:
    """``rows`` with the columns of ``table`` but ``uses``, which holds each key once.

    ``uses`` says how many rows have the key: the ``HOT_KEYS`` most frequent keys are
    broadcast, the others meet their rows by shuffle.
    """
    key = [key] if isinstance(key, str) else list(key)
    hot = F.broadcast(table.orderBy(F.desc(uses), *key).limit(HOT_KEYS).drop(uses))
    cold = rows.join(hot.select(*key), key, "left_anti").join(table.drop(uses).hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Alternates between linking larger neighbours and linking smaller neighbours to
    the smallest one; a table is written per step, and a few numbers reach the driver.
    """
    def pointed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                         F.least("a", "b").alias("b")).distinct()

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    def large_star(now: DataFrame) -> DataFrame:
        low = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        return now.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b"))

    def small_star(now: DataFrame) -> DataFrame:
        low = now.groupBy("a").agg(F.min("b").alias("low"))
        moved = now.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return pointed(moved.unionByName(low.select("a", F.col("low").alias("b"))))

    now = shelf.keep(pointed(edges), "edges")
    seen = fingerprint(now)
    while True:
        now = shelf.keep(small_star(large_star(now)), "edges")
        shelf.forget(shelf.paths[-2:-1])
        found = fingerprint(now)
        if found == seen:
            break
        seen = found
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))
                         .distinct()))
