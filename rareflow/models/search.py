"""Random search of training settings with successive halving.

Settings are drawn log-uniformly by keyed hash. All trials of a rung train side by side on one table of
rows; the better share goes on from where it stopped, with more epochs, until one is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from hashlib import md5

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from rareflow.models import kernel
from rareflow.models.dan import DisguiseModel, Training, training_round, training_rows
from rareflow.models.kernel import Adam, Shape

RUNG = "trial int, rung int, epochs int, lambd double, eta double, score double, goes_on boolean"


def log_uniform(low: float, high: float, name: str, number: int, seed: str = "search") -> float:
    """A number between ``low`` and ``high`` whose logarithm is uniform, from md5(seed:name:number)."""
    if not 0 < low <= high:
        raise ValueError("a log range needs 0 < low <= high")
    share = int(md5(f"{seed}:{name}:{number}".encode()).hexdigest()[:8], 16) / 16 ** 8
    return low * (high / low) ** share


def drawn_settings(count: int, ranges: Mapping[str, tuple[float, float]], seed: str = "search"
                   ) -> list[dict[str, float]]:
    return [{name: log_uniform(low, high, name, i, seed) for name, (low, high) in ranges.items()}
            for i in range(count)]


def survivors(scores: Mapping[int, float], share: int) -> list[int]:
    """The best ``1 / share`` of the trials, rounded up; ties and failed (NaN) ones by number."""
    order = sorted(scores, key=lambda t: (np.isnan(scores[t]), -scores[t], t))
    return sorted(order[:-(-len(order) // share)])


@dataclass
class Trial:
    """Settings and all that training goes on from; at most a rung of them is in memory."""

    number: int
    training: Training
    flat: np.ndarray
    adam: Adam
    epochs: int = 0
    log: list = field(default_factory=list)


def halving(train: DataFrame, validation: DataFrame, shape: Shape, training: Training,
            settings: Sequence[Mapping[str, float]], share: int = 2, epochs: int = 1,
            side_by_side: int = 4, features: str = "features", label: str = "label"
            ) -> tuple[DisguiseModel, list[tuple]]:
    """(best model, a row per trial and rung).

    A rung trains its trials ``epochs`` epochs, the next one ``share`` times as many. Trials run in
    ``side_by_side`` threads of the driver; each is a chain of Spark jobs, which share the executors. The result
    does not depend on which trial is done first.
    """
    if share < 2 or not settings:
        raise ValueError("halving needs trials and a share of two or more")
    spark = train.sparkSession
    rows = training_rows(train, features, label, training.workers)
    start = kernel.initial_weights(shape, training.seed)
    alive = [Trial(i, replace(training, **each), start.copy(), Adam(training.learning_rate))
             for i, each in enumerate(settings)]

    def model(trial: Trial) -> DisguiseModel:
        return DisguiseModel(shape, trial.flat, features, list(trial.log))

    def run(trial: Trial, more: int) -> float:
        for _ in range(more):
            trial.flat, losses = training_round(rows, shape, trial.training, trial.flat, trial.adam,
                                                trial.epochs)
            trial.epochs += 1
            trial.log += [(trial.epochs, tag, value) for tag, value in losses.items()]
        now = model(trial)
        score = now.evaluate(validation, label)[training.metric]
        now.release()
        return float(score)

    told, rung = [], 0
    with ThreadPoolExecutor(side_by_side) as pool:
        while True:
            work = inheritable_thread_target(spark)(run)
            scores = dict(zip([t.number for t in alive], pool.map(
                work, alive, [epochs * share ** rung] * len(alive)), strict=True))
            best = survivors(scores, share)
            last = len(alive) == 1
            told += [(t.number, rung, t.epochs, t.training.lambd, t.training.eta, scores[t.number],
                      t.number in best and not last) for t in alive]
            alive = [t for t in alive if t.number in best]
            if last:
                return model(alive[0]), told
            rung += 1


def rung_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RUNG)
