"""Embeddings of any size: a table with a row per (position, code), no flat vector.

A training step joins each row of the batch with its vectors, computes gradients in tasks,
sums those of the vectors by (position, code) and joins the sums with the table.
Codes that a step does not meet are not touched: a row remembers the step it was last moved in, and the
moves Adam would have made since then are made up when it is next read. The result is
that of dense Adam. Weights outside the table stay a broadcast vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rareflow.models import kernel
from rareflow.models.dan import (
    LABELLED, NEGATIVE, SUMS, Training, _step_metrics)
from rareflow.models.kernel import Adam, Given, Shape
from rareflow.models.passes import CHUNK, matrix
from rareflow.operators.encode import dictionary_join
from rareflow.session import materialize, scratch_path

MOVED = "position int, code bigint, vector array<double>, first array<double>, " \
        "second array<double>, step bigint"
PARTS = "kind int, position int, code bigint, values array<double>"
DENSE = -1                           # position of the chunks of dense gradients
NEGLIGIBLE = 1e-17                   # share of a momentum that is no longer made up


def initial_store(spark: SparkSession, shape: Shape, seed: int = 0) -> DataFrame:
    """Uniform Glorot vectors from a hash of (seed, position, code, place)."""
    parts = []
    for p in sorted(shape.stored):
        count = shape.index_map[p]
        parts.append(spark.range(count).select(
            F.lit(p).alias("position"), F.col("id").alias("code"),
            _drawn(seed, p, count, shape.embedding_dim(count)).alias("vector")))
    store = parts[0]
    for part in parts[1:]:
        store = store.unionByName(part)
    return unmoved(store)


def _drawn(seed: int, position: int, count: int, dim: int) -> Column:
    edge = (6.0 / (count + dim)) ** 0.5

    def number(i: Column) -> Column:
        mark = F.pmod(F.xxhash64(F.lit(seed), F.lit(position), "id", i), F.lit(1 << 52))
        return (mark / 2.0 ** 51 - 1.0) * edge

    return F.transform(F.sequence(F.lit(1), F.lit(dim)), number)


def unmoved(vectors: DataFrame) -> DataFrame:
    """(position, code, vector) as rows no step has moved yet."""
    zeros = F.transform("vector", lambda x: F.lit(0.0))
    return vectors.select(F.col("position").cast("int").alias("position"),
                          F.col("code").cast("long").alias("code"), "vector",
                          zeros.alias("first"), zeros.alias("second"),
                          F.lit(0).cast("long").alias("step"))


def _rate(adam: Adam, step: Column) -> Column:
    return (F.lit(adam.rate) * F.sqrt(1 - F.pow(F.lit(adam.second), step))
            / (1 - F.pow(F.lit(adam.first), step)))


def caught_up(adam: Adam, upto: int) -> Column:
    """``vector`` after the moves dense Adam makes until step ``upto`` without a gradient."""
    reach = ceil(log(NEGLIGIBLE) / log(adam.first)) if adam.first else 0
    last = F.least(F.lit(upto).cast("long"), F.col("step") + reach)

    def move(now: Column, s: Column) -> Column:
        ago = s - F.col("step")
        by = F.zip_with("first", "second", lambda m, v: _rate(adam, s) * m * F.pow(
            F.lit(adam.first), ago) / (F.sqrt(v * F.pow(F.lit(adam.second), ago)) + adam.eps))
        return F.zip_with(now, by, lambda x, d: x - d)

    return F.when((F.col("step") == 0) | (F.col("step") >= upto), F.col("vector")).otherwise(
        F.aggregate(F.sequence(F.col("step") + 1, last), F.col("vector"), move))


def attach(rows: DataFrame, store: DataFrame, shape: Shape, adam: Adam) -> DataFrame:
    """``rows`` (row, features, ...) with ``given``: their stored vectors, one after the other.

    Only codes and vectors move, in one shuffle by code and one by row; with one stored position the rows
    move instead, once. The table is broadcast while
    small; beyond, the most frequent codes are, so no task gets all rows of a hot code. A code
    without a row in the table has zeros.
    """
    places = sorted(shape.stored)
    dims = {p: shape.embedding_dim(shape.index_map[p]) for p in places}
    size = sum(shape.index_map[p] * (dims[p] * 8 + 48) for p in places)
    vectors = store.withColumn("vector", caught_up(adam, adam.steps))
    if len(places) == 1:                         # a row is its only cell: nothing has to meet again
        p = places[0]
        code = F.get("features", F.lit(p)).cast("long")
        found = dictionary_join(rows.withColumn("__code", code), vectors.where(
            F.col("position") == p).select(F.col("code").alias("value"), "vector"),
            "__code", "vector", "given", size)
        zeros = F.array(*[F.lit(0.0)] * dims[p])
        return found.withColumn("given", F.coalesce("given", zeros)).drop("__code")
    cells = rows.select("row", F.explode(F.array(*[F.struct(
        F.lit(p).alias("position"), F.get("features", F.lit(p)).cast("long").alias("code"))
        for p in places])).alias("c")).select("row", "c.position", F.concat_ws(
            ":", "c.position", "c.code").alias("cell"))
    vectors = vectors.select(F.concat_ws(":", "position", "code").alias("value"), "vector")
    found = dictionary_join(cells, vectors, "cell", "vector", "vector", size)
    zeros = F.create_map(*[x for p in places for x in (F.lit(p), F.array(*[F.lit(0.0)] * dims[p]))])
    found = found.withColumn("vector", F.coalesce("vector", zeros[F.col("position")]))
    given = found.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(
        F.struct("position", "vector"))), lambda x: x["vector"])).alias("given"))
    return rows.join(given, "row")


def _given(shape: Shape, batch: pa.RecordBatch, dtype: str) -> Given:
    whole, at, out = matrix(batch, "given", dtype), 0, {}
    for p in sorted(shape.stored):
        dim = shape.embedding_dim(shape.index_map[p])
        out[p] = whole[:, at:at + dim]
        at += dim
    return out


def _summed(kind: int, x: np.ndarray, stored: Given) -> Iterator[pa.RecordBatch]:
    """Gradients of stored vectors, summed by code within the batch."""
    for p, gradient in stored.items():
        codes, at = np.unique(x[:, p].astype(np.int64), return_inverse=True)
        sums = np.zeros((len(codes), gradient.shape[1]))
        np.add.at(sums, at, gradient)
        ends = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
        yield _parts(kind, p, codes, pa.ListArray.from_arrays(ends, sums.ravel()))


def _parts(kind: int, position: int, codes: Sequence[int], values: pa.ListArray) -> pa.RecordBatch:
    n = len(codes)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, position, np.int32)),
         pa.array(codes, pa.int64()), values], names=["kind", "position", "code", "values"])


def _dense(kind: int, flat: np.ndarray) -> pa.RecordBatch:
    pieces = [flat[i:i + CHUNK].astype("float64") for i in range(0, len(flat), CHUNK)]
    return _parts(kind, DENSE, range(len(pieces)), pa.array(pieces, pa.list_(pa.float64())))


def gradient(rows: DataFrame, store: DataFrame, shape: Shape, training: Training,
             flat: np.ndarray, adam: Adam) -> tuple[np.ndarray, DataFrame, dict[str, float]]:
    """(dense gradient, (position, code, gradient) of the codes met, losses) over all rows."""
    sent, dtype = rows.sparkSession.sparkContext.broadcast(flat), training.dtype
    adversarial = training.use_disguise and shape.disguise is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = kernel.as_blocks(shape, sent.value.astype(dtype)), np.zeros(7)
        dense = {LABELLED: np.zeros(shape.size), NEGATIVE: np.zeros(shape.size)}
        for batch in batches:
            x, given = matrix(batch, "features", dtype), _given(shape, batch, dtype)
            y = batch.column("label").to_numpy()
            loss, own, stored = kernel.labelled_parts(shape, w, x, y, given)
            dense[LABELLED] += own
            yield from _summed(LABELLED, x, stored)
            total[:2] += loss, len(y)
            zero = y == 0
            total[6] += zero.sum()
            if adversarial and zero.any():
                *sums, own, stored = kernel.disguise_parts(
                    shape, w, x[zero], training.lambd, training.eta,
                    {p: v[zero] for p, v in given.items()})
                dense[NEGATIVE] += own
                yield from _summed(NEGATIVE, x[zero], stored)
                total[2:6] += sums
        if total[1]:
            for kind, own in dense.items():
                yield _dense(kind, own)
            yield _dense(SUMS, total)

    joined = attach(rows, store, shape, adam).select("features", "label", "given")
    parts = materialize(joined.mapInArrow(work, PARTS), "gradients")
    sent.destroy()
    found = (parts.where(F.col("position") == DENSE).groupBy("kind", "code").agg(
        vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("sum"))
        .orderBy("kind", "code").collect())
    if not found:
        raise ValueError("no training rows")
    whole = {k: np.concatenate([r["sum"] for r in found if r["kind"] == k])
             for k in (LABELLED, NEGATIVE, SUMS)}
    total = whole[SUMS]
    scale = {LABELLED: 1.0 / total[1], NEGATIVE: 1.0 / max(total[6], 1.0)}
    weight = F.when(F.col("kind") == LABELLED, scale[LABELLED]).otherwise(scale[NEGATIVE])
    dims = {p: shape.embedding_dim(shape.index_map[p]) for p in shape.stored}
    # a column per place: sums of columns are taken in a hash table, vectors would be sorted first
    sums = [F.sum(F.get("values", F.lit(i)) * weight).alias(f"g{i}") for i in range(max(dims.values()))]
    length = F.create_map(*[F.lit(x) for item in dims.items() for x in item])[F.col("position")]
    sparse = parts.where(F.col("position") != DENSE).groupBy("position", "code").agg(*sums).select(
        "position", "code", F.slice(F.array(*[f"g{i}" for i in range(len(sums))]), 1, length)
        .alias("gradient"))
    dense = sum(whole[k] * scale[k] for k in (LABELLED, NEGATIVE))
    return dense, sparse, _step_metrics(total, shape, training)


def moved(store: DataFrame, gradients: DataFrame, adam: Adam, step: int) -> DataFrame:
    """The table after ``step`` (from 1): rows with a gradient are caught up and moved."""
    ago = F.lit(step) - F.col("step")
    joined = store.join(gradients, ["position", "code"], "left")
    first = F.zip_with("first", "gradient", lambda m, g: m * F.pow(F.lit(adam.first), ago)
                       + (1 - adam.first) * g)
    second = F.zip_with("second", "gradient", lambda v, g: v * F.pow(F.lit(adam.second), ago)
                        + (1 - adam.second) * g * g)
    met = F.col("gradient").isNotNull()
    new = joined.withColumns({"__first": first, "__second": second,
                              "__vector": caught_up(adam, step - 1)})
    by = F.zip_with("__first", "__second", lambda m, v: _rate(adam, F.lit(step)) * m
                    / (F.sqrt(v) + adam.eps))
    vector = F.zip_with("__vector", by, lambda x, d: x - d)
    keep = lambda now, old: F.when(met, now).otherwise(F.col(old)).alias(old)
    return new.select("position", "code", keep(vector, "vector"), keep(F.col("__first"), "first"),
                      keep(F.col("__second"), "second"), keep(F.lit(step).cast("long"), "step"))


class StoredModel:
    """Dense weights and the table of embeddings."""

    def __init__(self, shape: Shape, flat: np.ndarray, store: DataFrame, adam: Adam,
                 log: list[tuple[int, str, float]]):
        self.shape, self.flat, self.store, self.adam, self.log = shape, flat, store, adam, log

    def vectors(self) -> DataFrame:
        """(position, code, vector) as dense training would have left them."""
        return self.store.select("position", "code",
                                 caught_up(self.adam, self.adam.steps).alias("vector"))

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with the probability of the positive class in ``score``."""
        shape, flat = self.shape, self.flat
        kept = [c for c in df.columns if c != "score"]
        # written once: the numbers given to rows must not change between two reads
        rows = materialize(df.select(*kept).withColumn("__row", F.monotonically_increasing_id()),
                           "scored-rows")
        plain = rows.select(F.col("__row").alias("row"),
                            F.col(features).cast("array<double>").alias("features"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = kernel.as_blocks(shape, flat)
            for batch in batches:
                found = kernel.positive_probability(
                    shape, w, matrix(batch, "features", "float64"),
                    given=_given(shape, batch, "float64"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)],
                                                 names=["row", "score"])

        scored = attach(plain, self.store, shape, self.adam).select(
            "row", "features", "given").mapInArrow(work, "row long, score double")
        return rows.join(scored, F.col("__row") == F.col("row")).select(*kept, "score")


def fit_stored(df: DataFrame, shape: Shape, training: Training, rounds: int = 1,
               store: DataFrame | None = None, flat: np.ndarray | None = None) -> StoredModel:
    """Train on (features, label); an epoch takes ``rounds`` steps over as many parts of the rows.

    Codes stand in ``features`` at the positions of the shape's index map. The result does not
    depend on partitions. ``store`` and ``flat`` are where training starts, else they are drawn by
    ``training.seed``.
    """
    spark = df.sparkSession
    if not shape.stored:
        raise ValueError("no stored positions")
    path = scratch_path(spark, "stored-rows")
    part = F.pmod(F.xxhash64(F.col("features").cast("string"), "label"), F.lit(rounds)).cast("int")
    (df.select(F.col("features").cast("array<double>").alias("features"),
               F.col("label").cast("int").alias("label"))
     .withColumns({"row": F.monotonically_increasing_id(), "part": part})
     .write.partitionBy("part").parquet(path))
    rows = spark.read.schema("features array<double>, label int, row bigint, part int").parquet(path)
    flat = kernel.initial_weights(shape, training.seed) if flat is None else flat.copy()
    adam, losses = Adam(training.learning_rate), []
    store = materialize(initial_store(spark, shape, training.seed) if store is None else store,
                        "embeddings")
    for _ in range(training.epochs):
        for k in range(rounds):
            batch = rows.where(F.col("part") == k).drop("part")
            if rounds > 1 and batch.isEmpty():
                continue
            dense, sparse, metrics = gradient(batch, store, shape, training, flat, adam)
            store = materialize(moved(store, sparse, adam, adam.steps + 1), "embeddings")
            adam.step(flat, dense)
            losses += [(adam.steps, tag, value) for tag, value in metrics.items()]
    return StoredModel(shape, flat, store, adam, losses)
