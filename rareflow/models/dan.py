"""Disguise-adversarial classifier as an Estimator.

Each epoch is one Spark job: the weights are broadcast, every task trains on its
own rows, and the results are merged by a weighted mean on the executors. The
driver only sees the merged weights and metrics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rareflow.functions.scores import predicted_class
from rareflow.models import kernel
from rareflow.models.kernel import Shape
from rareflow.models.passes import CHUNK, chunks, matrix, run
from rareflow.operators.metrics import score_summary
from rareflow.session import materialize

WEIGHT_LIMIT = 50_000_000    # weights that may be broadcast (400 MB)


@dataclass(frozen=True)
class Training:
    """Training settings; defaults follow the published runs."""

    lambd: float = 1.0
    eta: float = 1.0
    learning_rate: float = 1e-3
    epochs: int = 5
    batch_size: int = 256
    use_disguise: bool = True
    sync: str = "average"        # or "gradient": one full-pass step per epoch
    early_stopping: int = 2
    metric: str = "auroc"        # or "auroc_micro"
    workers: int | None = None
    rounds_per_epoch: int = 1    # merges an epoch: each round trains on its own part of the rows
    seed: int = 0
    dtype: str = "float32"       # arithmetic inside the tasks


LABELLED, NEGATIVE, SUMS, FIRST, SECOND = range(5)


def _gradients(shape: Shape, training: Training, w: dict, x: np.ndarray, y: np.ndarray):
    """Sums of one batch: (labelled gradient, rows, negative gradient, negatives, metric sums)."""
    loss, labelled = kernel.labelled_terms(shape, w, x, y)
    negatives = x[y == 0]
    if training.use_disguise and shape.disguise is not None and len(negatives):
        entropy, quality, change, success, negative = kernel.disguise_terms(
            shape, w, negatives, training.lambd, training.eta)
    else:
        entropy = quality = change = success = 0.0
        negative = np.zeros_like(labelled)
    sums = np.array([loss, len(y), entropy, quality, change, success, len(negatives)], float)
    return labelled, negative, sums


def _step_metrics(sums: np.ndarray, shape: Shape, training: Training) -> dict[str, float]:
    """Mean losses of a pass from the sums of its batches."""
    n, negatives = sums[1], max(sums[6], 1.0)
    metrics = {"cross entropy": sums[0] / n}
    if training.use_disguise and shape.disguise is not None:
        entropy, quality, change = sums[2] / negatives, sums[3] / negatives, sums[4] / negatives
        metrics |= {
            "predictive entropy": entropy,
            "discriminator loss": metrics["cross entropy"] + training.eta * entropy,
            "disguise quality": quality, "disguise success rate": sums[5] / negatives,
            "regularizer": change, "disguise loss": training.lambd * change - quality}
    return {k: float(v) for k, v in metrics.items()}


def full_gradient(rows: DataFrame, shape: Shape, training: Training, flat: np.ndarray
                  ) -> tuple[np.ndarray, dict[str, float]]:
    """Gradient and losses over all rows at fixed weights; partitions do not matter."""
    sent, dtype = rows.sparkSession.sparkContext.broadcast(flat), training.dtype

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = kernel.as_blocks(shape, sent.value.astype(dtype)), np.zeros(7)
        labelled, negative = np.zeros_like(sent.value), np.zeros_like(sent.value)
        for batch in batches:
            a, b, sums = _gradients(shape, training, w, matrix(batch, "features", dtype),
                                    batch.column("label").to_numpy())
            labelled += a
            negative += b
            total += sums
        if total[1]:
            yield chunks(LABELLED, total[1], labelled / total[1])
            yield chunks(SUMS, 1.0, total)
        if total[6]:
            yield chunks(NEGATIVE, total[6], negative / total[6])

    merged = run(rows, work)
    sent.destroy()
    parts, mean = merged[SUMS]
    gradient = merged[LABELLED][1] + (merged[NEGATIVE][1] if NEGATIVE in merged else 0.0)
    return gradient, _step_metrics(mean * parts, shape, training)


def averaged_pass(rows: DataFrame, shape: Shape, training: Training, flat: np.ndarray,
                  state: kernel.Adam, epoch: int) -> tuple[np.ndarray, dict[str, float]]:
    """Every task trains on its own rows in mini-batches; weights and optimiser moments
    are averaged by the number of rows. ``state`` carries the moments from pass to pass."""
    sent, dtype = rows.sparkSession.sparkContext.broadcast((flat, state)), training.dtype

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = sent.value
        own, adam = start.astype(dtype), before.copied(len(start), dtype)
        rng, total = np.random.default_rng([training.seed, epoch]), np.zeros(7)
        for batch in batches:
            x, y = matrix(batch, "features", dtype), batch.column("label").to_numpy()
            order = rng.permutation(len(y))
            for at in range(0, len(y), training.batch_size):
                pick = order[at:at + training.batch_size]
                labelled, negative, sums = _gradients(
                    shape, training, kernel.as_blocks(shape, own), x[pick], y[pick])
                adam.step(own, labelled / sums[1] + negative / max(sums[6], 1.0))
                total += sums
        if total[1]:
            yield chunks(LABELLED, total[1], own)
            yield chunks(FIRST, total[1], adam.m)
            yield chunks(SECOND, total[1], adam.v)
            yield chunks(SUMS, 1.0, np.append(total, adam.steps * total[1]))

    merged = run(rows, work)
    sent.destroy()
    parts, mean = merged[SUMS]
    sums = mean * parts
    state.m, state.v = merged[FIRST][1], merged[SECOND][1]
    state.steps = round(sums[7] / sums[1])
    return merged[LABELLED][1], _step_metrics(sums[:7], shape, training)


def training_round(rows: DataFrame, shape: Shape, training: Training, flat: np.ndarray,
                   state: kernel.Adam, epoch: int) -> tuple[np.ndarray, dict[str, float]]:
    """One pass over (features, label); new weights and the mean step metrics."""
    if training.sync == "average":
        return averaged_pass(rows, shape, training, flat, state, epoch)
    gradient, metrics = full_gradient(rows, shape, training, flat)
    new = flat.copy()
    state.step(new, gradient)
    return new, metrics


def epoch_of_rounds(rows: DataFrame, shape: Shape, training: Training, flat: np.ndarray,
                    state: kernel.Adam, epoch: int) -> tuple[np.ndarray, dict[str, float]]:
    """One epoch with a merge after each round; the step metrics are means over the rounds.

    ``rows`` come from ``training_rows`` with as many rounds; a round without rows is left out.
    """
    rounds = training.rounds_per_epoch
    if rounds == 1:
        return training_round(rows, shape, training, flat, state, epoch)
    found = []
    for at in range(rounds):
        part = rows.where(F.col("round") == at).select("features", "label")
        if part.isEmpty():
            continue
        flat, metrics = training_round(part, shape, training, flat, state, epoch * rounds + at)
        found.append(metrics)
    if not found:
        raise ValueError("no training rows")
    return flat, {tag: float(np.mean([m[tag] for m in found])) for tag in found[0]}


def training_rows(df: DataFrame, features: str, label: str, workers: int | None,
                  rounds: int = 1, key: str | None = None) -> DataFrame:
    """Rows spread evenly over the workers, with the classes mixed, kept as a table.

    Round-robin after a local sort: even for copies, and stable under retries. With several
    ``rounds`` the table is cut by ``round``, by the hash of ``key`` or, without one, in turn
    within each worker's rows.
    """
    workers = workers or df.sparkSession.sparkContext.defaultParallelism
    narrow = [F.col(features).cast("array<double>").alias("features"),
              F.col(label).cast("int").alias("label")]
    if rounds == 1:
        return materialize(df.select(*narrow).repartition(workers), "training")
    dealt = F.lit(0) if key is None else F.col(key).cast("string")
    rows = df.select(*narrow, dealt.alias("round")).repartition(workers)
    turn = F.monotonically_increasing_id() if key is None else F.conv(F.substring(F.md5(
        F.concat(F.lit("round:"), F.coalesce("round", F.lit(""))).cast("binary")), 1, 8), 16, 10)
    cut = rows.withColumn("round", F.pmod(turn.cast("long"), F.lit(rounds)).cast("int"))
    return materialize(cut, "training", partition_by=["round"])


class DisguiseClassifier(Estimator):
    """Discriminator, alone or with a disguise network, on an array column."""

    def __init__(self, shape: Shape, training: Training = Training(), features: str = "features",
                 label: str = "label", validation: DataFrame | None = None,
                 checkpoint_dir: str | None = None, key: str | None = None):
        super().__init__()
        if shape.size > WEIGHT_LIMIT:
            raise ValueError(f"more than {WEIGHT_LIMIT} weights")
        self.shape, self.training, self.validation = shape, training, validation
        self.features, self.label, self.checkpoint_dir = features, label, checkpoint_dir
        self.key = key               # deals rows to rounds; None: any even deal

    def _fit(self, dataset: DataFrame) -> DisguiseModel:
        spark, training = dataset.sparkSession, self.training
        rounds = training.rounds_per_epoch
        rows = training_rows(dataset, self.features, self.label, training.workers, rounds, self.key)
        flat, step, best = kernel.initial_weights(self.shape, training.seed), 0, float("-inf")
        state = kernel.Adam(training.learning_rate)
        if self.checkpoint_dir:
            restored = load_checkpoint(spark, self.checkpoint_dir)
            if restored is not None:
                flat, step, best, state = restored[:4]
        log, kept, waited = [], flat, 0
        for epoch in range(training.epochs):
            flat, metrics = epoch_of_rounds(rows, self.shape, training, flat, state, step + epoch)
            at = step + epoch + 1
            log += [(at, tag, value) for tag, value in metrics.items()]
            if self.validation is None:
                kept = flat
                if self.checkpoint_dir:
                    save_checkpoint(spark, self.checkpoint_dir, flat, at, best, state)
                continue
            now = self._model(flat, log)
            scores = now.evaluate(self.validation, self.label)
            now.release()
            log += [(at, f"validation {tag}", value) for tag, value in scores.items()]
            if scores[training.metric] > best:
                best, kept, waited = scores[training.metric], flat, 0
                if self.checkpoint_dir:
                    save_checkpoint(spark, self.checkpoint_dir, flat, at, best, state)
            else:
                waited += 1
                if waited >= training.early_stopping:
                    break
        return self._model(kept, log)

    def _model(self, flat: np.ndarray, log: list) -> DisguiseModel:
        return DisguiseModel(self.shape, flat, self.features, list(log))


class DisguiseModel(Model):
    """Fitted weights; scoring and disguising of tables and streams.

    The weights are broadcast once, at the first use; ``release`` takes them off the executors, after
    which columns made before cannot be evaluated any more.
    """

    def __init__(self, shape: Shape, flat: np.ndarray, features: str = "features",
                 log: list | None = None):
        super().__init__()
        self.shape, self.flat, self.features, self.log = shape, flat, features, log or []
        self._broadcast = None

    def _sent(self):
        if self._broadcast is None:
            # the session there is: threads of a search have no active one
            spark = SparkSession.builder.getOrCreate()
            self._broadcast = spark.sparkContext.broadcast(self.flat)
        return self._broadcast

    def release(self) -> None:
        if self._broadcast is not None:
            self._broadcast.destroy()
            self._broadcast = None

    def _linear_score(self) -> Column:
        """Logistic case in column arithmetic, inside the JVM."""
        w = kernel.as_blocks(self.shape, self.flat)
        slope = (w["d0w"][:, 1] - w["d0w"][:, 0]).tolist()
        bias = float(w["d0b"][1] - w["d0b"][0])
        terms = F.zip_with(F.col(self.features).cast("array<double>"),
                           F.array(*[F.lit(s) for s in slope]), lambda a, b: a * b)
        logit = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) + F.lit(bias)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self) -> Column:
        """Probability of the positive class as a column expression."""
        if not self.shape.discriminator and not self.shape.index_map:
            return self._linear_score()
        shape, sent = self.shape, self._sent()

        @F.pandas_udf("double")
        def positive(rows: pd.Series) -> pd.Series:
            w = kernel.as_blocks(shape, sent.value)
            x = np.stack(rows.to_numpy()).astype("float64")
            return pd.Series(kernel.positive_probability(shape, w, x))

        return positive(F.col(self.features).cast("array<double>"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("score", self.score())

    def predict_proba(self, dataset: DataFrame) -> DataFrame:
        """Both class probabilities."""
        return self.transform(dataset).withColumn("proba_negative", F.lit(1.0) - F.col("score")) \
            .withColumnRenamed("score", "proba_positive")

    def predict(self, dataset: DataFrame) -> DataFrame:
        """Indicator of each class whose probability reaches one half."""
        both = self.predict_proba(dataset)
        return both.select(
            *dataset.columns, predicted_class(F.col("proba_negative")).alias("negative"),
            predicted_class(F.col("proba_positive")).alias("positive"))

    def disguise(self, dataset: DataFrame, out: str = "disguised") -> DataFrame:
        """Adds the embedded and the disguised row of (negative) rows."""
        if self.shape.disguise is None:
            raise AttributeError("the model has no disguise network")
        shape, sent = self.shape, self._sent()

        @F.pandas_udf("struct<plain: array<double>, changed: array<double>>")
        def change(rows: pd.Series) -> pd.DataFrame:
            w = kernel.as_blocks(shape, sent.value)
            x = np.stack(rows.to_numpy()).astype("float64")
            return pd.DataFrame({"plain": list(kernel.embed(shape, w, x)),
                                 "changed": list(kernel.disguised(shape, w, x))})

        both = change(F.col(self.features).cast("array<double>"))
        return dataset.withColumn("__both", both).select(
            *dataset.columns, F.col("__both.plain").alias("embedded"),
            F.col("__both.changed").alias(out))

    def evaluate(self, dataset: DataFrame, label: str = "label") -> dict[str, float]:
        """Cross entropy, accuracy and both AUROCs on a table."""
        summary = score_summary(self.transform(dataset), label)
        return summary.select("cross_entropy", "accuracy", "auroc", "auroc_micro").first().asDict()

    def log_table(self, spark: SparkSession, run: str = "run") -> DataFrame:
        """(run, step, tag, value) of the training."""
        return spark.createDataFrame([(run, s, t, float(v)) for s, t, v in self.log],
                                     "run string, step bigint, tag string, value double")

    def save(self, path: str) -> None:
        spark = SparkSession.builder.getOrCreate()
        meta = json.dumps({"shape": asdict(self.shape), "features": self.features})
        _weights_table(spark, self.flat).withColumn("meta", F.lit(meta)).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DisguiseModel:
        rows = spark.read.parquet(path).orderBy("chunk").collect()
        meta = json.loads(rows[0]["meta"])
        shape = meta["shape"]
        shape["index_map"] = {int(k): v for k, v in shape["index_map"].items()}
        for part in ("discriminator", "disguise", "stored"):
            shape[part] = None if shape[part] is None else tuple(shape[part])
        flat = np.concatenate([r["values"] for r in rows])
        return DisguiseModel(Shape(**shape), flat, meta["features"])


def _weights_table(spark: SparkSession, flat: np.ndarray) -> DataFrame:
    rows = [(i // CHUNK, [float(v) for v in flat[i:i + CHUNK]])
            for i in range(0, len(flat), CHUNK)]
    return spark.createDataFrame(rows, "chunk int, values array<double>")


KEEP_CHECKPOINTS = 3


def _versions(spark: SparkSession, path: str) -> tuple[object, list]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("step=")]
    complete = [p for p in found if fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return fs, sorted(complete, key=lambda p: int(p.getName().split("=")[1]))


class Checkpoint(NamedTuple):
    """Weights with all that training goes on from."""

    flat: np.ndarray
    step: int
    best: float
    state: kernel.Adam
    stream_pass: int             # of a stream, -1 for tables
    stream_batch: int


def save_checkpoint(spark: SparkSession, path: str, flat: np.ndarray, step: int, best: float,
                    state: kernel.Adam | None = None, stream_pass: int = -1,
                    stream_batch: int = -1) -> None:
    """Write weights and optimiser state as version ``step``; the newest three versions stay."""
    state = (state or kernel.Adam()).copied(len(flat), "float64")
    rows = [(i // CHUNK, *([float(v) for v in part[i:i + CHUNK]] for part in (
        flat, state.m, state.v))) for i in range(0, len(flat), CHUNK)]
    table = spark.createDataFrame(
        rows, "chunk int, values array<double>, first array<double>, second array<double>")
    known = {"best": float(best), "steps": state.steps, "rate": state.rate,
             "stream_pass": stream_pass, "stream_batch": stream_batch}
    table.withColumns({k: F.lit(v) for k, v in known.items()}).write.mode("overwrite").parquet(
        f"{path}/step={step}")
    fs, versions = _versions(spark, path)
    for old in versions[:-KEEP_CHECKPOINTS]:
        fs.delete(old, True)


def load_checkpoint(spark: SparkSession, path: str) -> Checkpoint | None:
    """The newest version, None without one."""
    _, versions = _versions(spark, path)
    if not versions:
        return None
    newest = versions[-1]
    rows = spark.read.parquet(newest.toString()).orderBy("chunk").collect()
    flat, first, second = (np.concatenate([r[c] for r in rows])
                           for c in ("values", "first", "second"))
    top = rows[0]
    state = kernel.Adam(top["rate"], steps=top["steps"], m=first, v=second)
    return Checkpoint(flat, int(newest.getName().split("=")[1]), top["best"], state,
                      top["stream_pass"], top["stream_batch"])
