"""Order and batches that outlast micro-batches: a bounded shuffle buffer, batches of exactly n.

Rows are dealt to lanes by a hash of their key. A lane takes the rows of a micro-batch in the order of a column, so
with files read in order its output does not depend on how the stream is cut into micro-batches. One lane
is the order of a single reader.

Where a row goes depends on its number in the lane and on how many rows have come, not on other rows. So a micro-batch is
range-partitioned, sorted and written once, whatever the number of lanes, and a small table says with which
number each slice starts; places are computed when rows are read. What has been written and how many rows have come
is the state: a stopped stream goes on where it was, and a micro-batch that is run again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rareflow.functions.hashing import hash_token
from rareflow.session import scratch_path
from rareflow.streaming.streams import run_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"     # the caller's, never touched
STARTS = "lane int, slice bigint, first bigint, before bigint, batch int"
TOTALS = "lane int, total bigint"
BLOCK = 16_384                # arrivals whose successors are looked up at once
SLICE_BITS = 33               # monotonically_increasing_id: rows below, partitions above


def slot_of(seed: str, lane: int, arrival: int, size: int) -> int:
    """The slot that the arrival of this number takes over; the first ones fill the buffer."""
    if arrival <= size:
        return arrival - 1
    return int(md5(f"{seed}:{lane}:{arrival}".encode()).hexdigest()[:8], 16) % size


class ShuffleBuffer:
    """Holds ``size`` rows; each further row takes a slot by hash and sends out the row it held."""

    def __init__(self, size: int, seed: str):
        self.size, self.seed = size, seed

    def held(self, total: Column) -> Column:
        return F.least(total, F.lit(self.size))

    def place(self) -> Column:
        """Of (lane, number, total): the place of a row sent out, from 1, else minus its slot."""
        size, seed, width = self.size, self.seed, max(BLOCK, self.size)
        if size == 1:                            # each arrival sends out the one before it
            return F.when(F.col("number") < F.col("total"), F.col("number")).otherwise(F.lit(0))

        def work(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            block = lru_cache(maxsize=4)(
                lambda lane, k, total: places(seed, lane, k * width + 1, width, total, size))
            for lane, number, total in parts:
                out = pd.Series(0, index=number.index, dtype="int64")
                for (at, k, upto), rows in number.groupby([lane, (number - 1) // width, total]):
                    out.loc[rows.index] = block(at, k, upto)[rows.to_numpy() - k * width - 1]
                yield out

        # not deterministic for the planner: a filter on the places must not compute them twice
        return F.pandas_udf(work, "bigint").asNondeterministic()("lane", "number", "total")


class FixedBatches:
    """Sends out rows in batches of exactly ``size``; fewer wait for the next micro-batch."""

    def __init__(self, size: int):
        self.size = size

    def held(self, total: Column) -> Column:
        return F.pmod(total, F.lit(self.size))

    def place(self) -> Column:
        number, sent = F.col("number"), F.col("total") - self.held(F.col("total"))
        return F.when(number <= sent, number).otherwise(sent + 1 - number)


def places(seed: str, lane: int, first: int, width: int, total: int, size: int) -> np.ndarray:
    """For ``width`` arrivals from ``first`` on: the place at which the next arrival in its slot sends it
    out; minus the slot, if none of ``total`` arrivals does.

    Slots are hashes of numbers, so the arrivals behind the block are looked up without their rows, about
    ``size`` times the logarithm of ``width`` of them.
    """
    last = min(first + width - 1, total)
    reach, slots = first - 1, np.zeros(0, dtype="int64")
    upto = min(total, last + 4 * size)
    while True:
        more = range(reach + 1, upto + 1)
        slots = np.concatenate([slots, np.array(
            [slot_of(seed, lane, t, size) for t in more], dtype="int64")])
        order = np.argsort(slots, kind="stable")
        same = slots[order[1:]] == slots[order[:-1]]
        after = np.zeros(len(slots), dtype="int64")
        after[order[:-1][same]] = first + order[1:][same]
        after = after[:last - first + 1]
        if upto == total or after.all():
            return np.where(after > 0, after - size, -slots[:len(after)])
        reach, upto = upto, min(total, upto + len(slots))


class Lanes:
    """A stream of rows through lanes into tables below ``folder``.

    ``order`` sorts the rows of a micro-batch, then their text; ``key`` deals them to lanes (null: the first).
    Calling ``run`` again with the same folder goes on with what has arrived since.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, lanes: int = 1,
                 seed: str = "lane"):
        self.spark, self.lanes, self.seed = spark, lanes, seed
        self.folder = folder or scratch_path(spark, "lanes")
        self.schema = self.rule = None

    def run(self, stream: DataFrame, key: str, order: str, rule: ShuffleBuffer | FixedBatches) -> None:
        self.schema, self.rule = stream.schema, rule
        number = F.conv(F.substring(hash_token(key, self.seed), 1, 8), 16, 10).cast("long")
        lane = F.coalesce(F.pmod(number, F.lit(self.lanes)).cast("int"), F.lit(0))
        dealt = stream.select(lane.alias("lane"), F.struct(*stream.columns).alias("row"))
        first = F.col("row").getField(order).asc_nulls_last()
        keys = [*(["lane"] if self.lanes > 1 else []), first, F.to_json("row")]

        def work(batch: DataFrame, at: int) -> None:
            if at and self._last() < at - 1:
                raise ValueError(f"{self.folder} holds no rows of micro-batch {at - 1}")
            (batch.repartitionByRange(*keys).sortWithinPartitions(*keys)
             .withColumn("at", F.monotonically_increasing_id())
             .write.mode("overwrite").parquet(f"{self.folder}/rows/batch={at}"))
            self._count(at)
            hadoop = self.spark._jvm.org.apache.hadoop.fs
            self._files().create(hadoop.Path(f"{self.folder}/done/{at}"), True).close()

        run_batches(dealt, work, checkpoint=f"{self.folder}/state")

    def _count(self, at: int) -> None:
        """Write the number that each slice of a micro-batch starts behind, and the rows per lane so far."""
        slices = (self._rows(at, at).groupBy("lane", F.shiftright("at", SLICE_BITS).alias("slice"))
                  .agg(F.min("at").alias("first"), F.count("*").alias("n")))
        seen = self._totals(at - 1)
        upto = F.sum("n").over(Window.partitionBy("lane").orderBy("slice"))   # one row per slice
        (slices.join(seen, "lane", "left").select(
            "lane", "slice", "first", (F.coalesce("total", F.lit(0)) + upto - F.col("n")).alias("before"))
         .write.mode("overwrite").parquet(f"{self.folder}/starts/batch={at}"))
        new = slices.select("lane", F.col("n").alias("total")).unionByName(seen)
        (new.groupBy("lane").agg(F.sum("total").alias("total"))
         .write.mode("overwrite").parquet(f"{self.folder}/totals/batch={at}"))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The last micro-batch written as a whole, -1 if there is none."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        if not self._files().exists(done):
            return -1
        return max((int(s.getPath().getName()) for s in self._files().listStatus(done)), default=-1)

    def _rows(self, first: int, last: int) -> DataFrame:
        if last < 0:
            return self._empty(self._row_schema())
        return (self.spark.read.schema(self._row_schema()).parquet(f"{self.folder}/rows")
                .where(F.col("batch").between(first, last)))

    def _row_schema(self):
        return (T.StructType().add("lane", T.IntegerType()).add("row", self.schema)
                .add("at", T.LongType()).add("batch", T.IntegerType()))

    def _empty(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _totals(self, at: int) -> DataFrame:
        if at < 0:
            return self._empty(TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/totals/batch={at}")

    def counts(self) -> DataFrame:
        """(lane, sent, held): rows sent out and held so far."""
        held = self.rule.held(F.col("total"))
        return self._totals(self._last()).select(
            "lane", (F.col("total") - held).alias("sent"), held.alias("held"))

    def _placed(self) -> DataFrame:
        last = self._last()
        starts = self._empty(STARTS) if last < 0 else self.spark.read.schema(STARTS).parquet(
            f"{self.folder}/starts").where(F.col("batch") <= last)
        rows = self._rows(0, last).withColumn("slice", F.shiftright("at", SLICE_BITS))
        return (rows.join(F.broadcast(starts), ["batch", "lane", "slice"])
                .join(F.broadcast(self._totals(last)), "lane")
                .select("lane", "row", "total",
                        (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"))
                .select("lane", "row", self.rule.place().alias("place")))

    def sent(self) -> DataFrame:
        """(lane, place from 1, columns of the stream) of the rows sent out so far."""
        return self._opened(self._placed().where("place > 0"), F.col("place"))

    def held(self) -> DataFrame:
        """(lane, slot, columns of the stream) of the rows still held."""
        return self._opened(self._placed().where("place <= 0"), (-F.col("place")).alias("slot"))

    def _opened(self, placed: DataFrame, at: Column) -> DataFrame:
        return placed.select("lane", at, *[F.col("row").getField(c).alias(c)
                                           for c in self.schema.names])


def shuffle_buffer(stream: DataFrame, key: str, order: str, size: int, lanes: int = 1,
                   seed: str = "buffer", folder: str | None = None) -> Lanes:
    """Rows in the order of a buffer of ``size`` rows per lane; 1 keeps the order of arrival."""
    if size < 1:
        raise ValueError("a buffer holds one row at least")
    run = Lanes(stream.sparkSession, folder, lanes)
    run.run(stream, key, order, ShuffleBuffer(size, seed))
    return run


def fixed_batches(stream: DataFrame, key: str, order: str, size: int, lanes: int = 1,
                  folder: str | None = None) -> Lanes:
    """Rows numbered within batches of exactly ``size`` rows per lane: batch = (place - 1) / size."""
    if size < 1:
        raise ValueError("a batch holds one row at least")
    run = Lanes(stream.sparkSession, folder, lanes)
    run.run(stream, key, order, FixedBatches(size))
    return run


def drained(run: Lanes, seed: str = "buffer") -> DataFrame:
    """All rows with their places: those sent, then the ones held, by hash of their slot."""
    mark = F.md5(F.concat_ws(":", F.lit(f"{seed}:end"), "lane", "slot").cast("binary"))
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(mark))      # ``size`` rows per lane
    rest = run.held().join(F.broadcast(run.counts().select("lane", F.col("sent").alias("__upto"))), "lane")
    return run.sent().unionByName(
        rest.withColumn("place", F.col("__upto") + rank).drop("__upto", "slot"))
