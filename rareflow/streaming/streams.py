"""Streams over a folder of CSV shards.

Sinks are keyed by the micro-batch number, so a batch that is run again after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rareflow.models import kernel
from rareflow.models.dan import (
    DisguiseModel, Training, load_checkpoint, save_checkpoint, training_round)
from rareflow.models.kernel import Shape
from rareflow.operators.encode import default_then_scale, encode_codes
from rareflow.operators.metrics import micro_auroc_from_counts, micro_counts
from rareflow.operators.sample import shuffle_rows
from rareflow.session import scratch_path
from rareflow.sources.files import fill_defaults


def read_shards_stream(spark: SparkSession, path: str, schema: T.StructType,
                       files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("header", True)
            .option("maxFilesPerTrigger", files_per_batch).csv(path))


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str = "append",
                checkpoint: str | None = None) -> None:
    """Process everything available, micro-batch by micro-batch, then stop.

    With a ``checkpoint`` of the caller's, a stopped run goes on where it was.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    query = (stream.writeStream.foreachBatch(work).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def write_stream(stream: DataFrame, label: str) -> DataFrame:
    """Run a stateless stream into a Parquet table (exactly once) and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", scratch_path(spark, f"{label}-checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def encode_stream(rows: DataFrame, vocabulary: DataFrame, stats: Mapping[str, tuple[float, float]],
                  categorical: Sequence[str], numeric: Sequence[str],
                  sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Defaults, codes with an out-of-vocabulary slot, standardised numbers.

    The same projection for a stream and for a table.
    """
    filled = fill_defaults(rows, categorical, [])
    coded = encode_codes(filled, vocabulary, categorical, "oov", "_idx", sizes)
    return default_then_scale(coded, stats, numeric).drop(*categorical)


def shuffle_stream(stream: DataFrame, key: str, label: str = "stream-shuffle",
                   seed: str = "shuffle") -> DataFrame:
    """Pseudo-random order within each micro-batch, the stream's shuffle window."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def work(batch: DataFrame, number: int) -> None:
        shuffle_rows(batch, key, f"{seed}:{number}").write.mode("overwrite") \
            .parquet(f"{path}/window={number}")

    run_batches(stream, work)
    return spark.read.parquet(path)


def train_batch(batch: DataFrame, number: int, stream_pass: int, shape: Shape,
                training: Training, path: str) -> dict[str, float] | None:
    """One training round on a micro-batch; None if it is empty or was applied before.

    The state is the checkpoint of the previous micro-batch, so a batch that is run
    again after a failure changes nothing.
    """
    spark = batch.sparkSession
    before = load_checkpoint(spark, path)
    if before is None:
        flat, step = kernel.initial_weights(shape, training.seed), 0
        state = kernel.Adam(training.learning_rate)
    elif (before.stream_pass, before.stream_batch) >= (stream_pass, number):
        return None
    else:
        flat, step, state = before.flat, before.step, before.state
    if batch.isEmpty():
        return None
    flat, metrics = training_round(batch, shape, training, flat, state, step)
    save_checkpoint(spark, path, flat, step + 1, float("-inf"), state, stream_pass, number)
    return metrics


def _passes(spark: SparkSession, path: str) -> tuple[object, Callable[[int], object], int]:
    """(file system, path of a pass's end mark, first pass without one)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = lambda k: hadoop.Path(f"{path}/done/pass={k}")
    done = fs.listStatus(hadoop.Path(f"{path}/done")) if fs.exists(
        hadoop.Path(f"{path}/done")) else []
    ended = [int(s.getPath().getName().split("=")[1]) for s in done]
    return fs, mark, max(ended, default=-1) + 1


def fit_stream(stream: DataFrame, shape: Shape, training: Training, checkpoint_dir: str,
               validation: DataFrame | None = None, epochs: int = 1,
               train: DataFrame | None = None) -> DisguiseModel:
    """Train on micro-batches of (features, label), pass after pass over the stream.

    ``checkpoint_dir`` keeps weights, optimiser state and the position in the stream: a run
    that was stopped goes on in the pass it was in, and a later call with another stream
    trains on. Losses are logged per pass; ``train`` and ``validation`` tables are
    scored after each. With ``validation`` training stops when ``training.metric`` has not
    improved for ``training.early_stopping`` passes, and the best weights are returned.
    """
    spark, weights, best_dir = stream.sparkSession, f"{checkpoint_dir}/weights", \
        f"{checkpoint_dir}/best"
    kept = load_checkpoint(spark, best_dir)
    best, waited, log = kept.best if kept else float("-inf"), 0, []
    for _ in range(epochs):
        fs, mark, number = _passes(spark, checkpoint_dir)
        losses: list[dict[str, float]] = []

        def work(batch: DataFrame, at: int, number: int = number, losses: list = losses) -> None:
            found = train_batch(batch, at, number, shape, training, weights)
            if found is not None:
                losses.append(found)

        run_batches(stream, work, checkpoint=f"{checkpoint_dir}/stream/pass={number}")
        fs.create(mark(number), True).close()
        state = load_checkpoint(spark, weights)
        if state is None:
            raise ValueError("the stream held no training rows")
        model = DisguiseModel(shape, state.flat, log=log)
        for tag in losses[0] if losses else ():
            log.append((state.step, tag, sum(x[tag] for x in losses) / len(losses)))
        if train is not None:
            log += [(state.step, f"train {k}", v) for k, v in model.evaluate(train).items()]
        if validation is None:
            continue
        scores = model.evaluate(validation)
        log += [(state.step, f"validation {k}", v) for k, v in scores.items()]
        if scores[training.metric] > best:
            best, waited = scores[training.metric], 0
            save_checkpoint(spark, best_dir, state.flat, state.step, best, state.state)
        else:
            waited += 1
            if waited >= training.early_stopping:
                break
    final = load_checkpoint(spark, weights if validation is None else best_dir)
    return DisguiseModel(shape, (final or state).flat, log=log)


def predict_stream(stream: DataFrame, model: DisguiseModel, keep: Sequence[str],
                   label: str = "stream-scores") -> DataFrame:
    """Scores next to the labels, as a table."""
    return write_stream(model.transform(stream).select(*keep, "score"), label)


def stream_metrics(stream: DataFrame, y: str = "y", p: str = "score") -> DataFrame:
    """Accuracy and micro AUROC after the whole stream.

    The only state is one row per threshold bucket.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-metrics")
    last = {"number": None}

    def work(counts: DataFrame, number: int) -> None:
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/{number}")
        last["number"] = number

    run_batches(micro_counts(stream, y, p), work, "complete")
    if last["number"] is None:
        raise ValueError("the stream held no rows")
    counts = spark.read.parquet(f"{path}/{last['number']}")
    cells = F.sum(F.col("pos") + F.col("neg"))
    correct = counts.agg((F.sum("hits") / cells).alias("accuracy"),
                         cells.alias("cells"))
    return correct.withColumn("auroc_micro", micro_auroc_from_counts(counts).scalar())
