"""One pass over rows that sums long vectors on the executors.

A task yields its vectors as chunks; chunks meet by position, first within lanes of about
the square root of the tasks, then across lanes, so no task receives more than some square root of
the tasks' chunks. The driver sees the merged vectors only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

CHUNK = 65_536               # numbers per merged row
CHUNK_SCHEMA = "kind int, chunk int, weight double, values array<double>"
Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def matrix(batch: pa.RecordBatch, column: str, dtype: str = "float64") -> np.ndarray:
    """The arrays of a column as rows of a matrix."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) \
        .astype(dtype)


def chunks(kind: int, weight: float, flat: np.ndarray) -> pa.RecordBatch:
    """A vector of a task, to be averaged by weight with those of the same kind."""
    parts = [flat[i:i + CHUNK] for i in range(0, len(flat), CHUNK)]
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(parts), pa.int32()),
        "chunk": pa.array(range(len(parts)), pa.int32()),
        "weight": pa.array([float(weight)] * len(parts), pa.float64()),
        "values": pa.array([p.astype("float64") for p in parts], pa.list_(pa.float64()))})


def merged(parts: DataFrame, lanes: int | None = None) -> DataFrame:
    """(kind, chunk, weight, mean): weighted means of the chunks, merged in two levels."""
    lanes = lanes or math.isqrt(max(parts.sparkSession.sparkContext.defaultParallelism - 1, 0)) + 1

    def mean(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            Summarizer.mean(F.col("vector"), F.col("weight")).alias("vector"),
            F.sum("weight").alias("weight"))

    dealt = parts.select("kind", "chunk", "weight", array_to_vector("values").alias("vector"),
                         (F.spark_partition_id() % lanes).alias("lane"))
    both = mean(mean(dealt, "kind", "chunk", "lane") if lanes > 1 else dealt, "kind", "chunk")
    return both.select("kind", "chunk", "weight", vector_to_array("vector").alias("mean"))


def run(rows: DataFrame, work: Work, lanes: int | None = None
        ) -> dict[int, tuple[float, np.ndarray]]:
    """Weighted mean of every kind of vector that ``work`` yields: {kind: (weight, vector)}."""
    found = merged(rows.mapInArrow(work, CHUNK_SCHEMA), lanes).orderBy("kind", "chunk").collect()
    if not found:
        raise ValueError("no training rows")
    return {k: (next(r["weight"] for r in found if r["kind"] == k),
                np.concatenate([r["mean"] for r in found if r["kind"] == k]))
            for k in {r["kind"] for r in found}}
