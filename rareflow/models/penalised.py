"""Logistic regressions of many penalties, advanced together.

A pass evaluates loss and slope of every penalty at its own point: per batch one product of rows
and weights gives all margins, one more all slopes. Each penalty walks by limited-memory
quasi-Newton steps of its own; those that have arrived leave the pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from rareflow.models import passes
from rareflow.operators import metrics
from rareflow.session import materialize

MEMORY = 10                  # steps that shape the next direction
DECREASE = 1e-4              # share of the promised decrease that a step has to bring
ROUNDING = 1e-14             # relative change of a loss that counts as none


class Walk:
    """Minimises one smooth convex function that others evaluate: ``point``, then ``told``."""

    def __init__(self, start: np.ndarray, tolerance: float):
        self.at, self.loss, self.slope = start, np.inf, np.zeros_like(start)
        self.direction, self.step, self.tolerance = np.zeros_like(start), 1.0, tolerance
        self.past: deque = deque(maxlen=MEMORY)
        self.done = False

    @property
    def point(self) -> np.ndarray:
        return self.at + self.step * self.direction

    def told(self, loss: float, slope: np.ndarray) -> None:
        """Takes or halves the step, given loss and slope at ``point``."""
        promised = DECREASE * self.step * (self.slope @ self.direction)
        if np.isfinite(self.loss) and loss > self.loss + promised + ROUNDING * abs(self.loss):
            self.step /= 2
            self.done = self.step < 1e-12
            return
        moved, turned = self.point - self.at, slope - self.slope
        if moved @ turned > 0:
            self.past.append((moved, turned))
        self.at, self.loss, self.slope = self.point, loss, slope
        self.done = bool(np.abs(slope).max() <= self.tolerance)
        self.direction, self.step = -self._bent(slope), 1.0

    def _bent(self, slope: np.ndarray) -> np.ndarray:
        """The slope times the inverse curvature that past steps have shown."""
        out, shares = slope.copy(), []
        for moved, turned in reversed(self.past):
            share = (moved @ out) / (moved @ turned)
            out -= share * turned
            shares.append(share)
        if self.past:
            moved, turned = self.past[-1]
            out *= (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.past, reversed(shares)):
            out += (share - (turned @ out) / (moved @ turned)) * moved
        return out


class PenaltyPath:
    """Logistic regressions with an L2 penalty of inverse strength ``c`` for every c of a grid.

    Minimises the mean log loss plus |w|^2 / (2 c n); the offset is free. ``weights`` has a row
    per c, ``offsets`` a number, ``passes`` says how often the rows were read. Rows without
    features or label take no part; a column that does not vary gets weight 0.
    """

    def __init__(self, train: DataFrame, label: str, features: str = "features",
                 grid: Sequence[float] = tuple(np.linspace(0.001, 100, 30)),
                 tolerance: float = 1e-9, most: int = 500):
        self.grid, self.features, self.passes = [float(c) for c in grid], features, 0
        rows = materialize(train.where(F.col(features).isNotNull() & F.col(label).isNotNull())
                           .select(F.col(features).cast("array<double>").alias("features"),
                                   F.col(label).cast("double").alias("label")), "path-rows")
        if rows.isEmpty():
            raise ValueError("no training rows")
        spread = rows.select(Summarizer.metrics("mean", "variance", "count").summary(
            array_to_vector("features")).alias("s")).first()["s"]
        n, mean = spread["count"], spread["mean"].toArray()
        scale = np.sqrt(spread["variance"].toArray())
        scale[scale == 0] = 1.0
        # in scaled units: the offset first, then a weight per column
        burdens = [np.append(0.0, 1.0 / (c * n * scale ** 2)) for c in self.grid]
        walks = [Walk(np.zeros(len(mean) + 1), tolerance) for _ in self.grid]
        while active := [i for i, walk in enumerate(walks) if not walk.done]:
            if self.passes == most:
                raise RuntimeError(f"penalties did not settle within {most} passes")
            points = np.array([walks[i].point for i in active])
            losses, slopes = losses_and_slopes(rows, mean, scale, points)
            self.passes += 1
            for at, i in enumerate(active):
                burden = burdens[i] * points[at]
                walks[i].told(losses[at] + burden @ points[at] / 2, slopes[at] + burden)
        found = np.array([walk.at for walk in walks])
        self.weights = found[:, 1:] / scale
        self.offsets = found[:, 0] - self.weights @ mean

    def scores(self) -> Column:
        """Array of the positive class's probability under each penalty."""
        values = F.col(self.features).cast("array<double>")
        out = []
        for offset, weights in zip(self.offsets, self.weights):
            terms = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]),
                               lambda a, b: a * b)
            out.append(F.lit(1.0) / (F.lit(1.0) + F.exp(
                -F.aggregate(terms, F.lit(float(offset)), lambda acc, v: acc + v))))
        return F.array(*out)

    def auroc(self, df: DataFrame, label: str) -> DataFrame:
        """(c, auroc): exact rank form for all penalties, one pass over ``df``."""
        cells = df.select(F.col(label).alias("y"), F.posexplode(self.scores()).alias("at", "score"))
        at = metrics.auroc_by(cells, "at")
        grid = df.sparkSession.createDataFrame(list(enumerate(self.grid)), "at int, c double")
        return grid.join(at, "at").select("c", "auroc")


def losses_and_slopes(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, points: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Mean log losses and their slopes at every point, in one pass over (features, label)."""
    sent = rows.sparkSession.sparkContext.broadcast((mean, scale, points))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, unit, at = sent.value
        n, total = 0, np.zeros((at.shape[0], at.shape[1] + 1))
        for batch in batches:
            x = (passes.matrix(batch, "features") - centre) / unit
            y = batch.column("label").to_numpy()[:, None]
            margin = x @ at[:, 1:].T + at[:, 0]
            miss = 0.5 * (1.0 + np.tanh(margin / 2)) - y
            total[:, 0] += (np.logaddexp(0.0, margin) - y * margin).sum(axis=0)
            total[:, 1] += miss.sum(axis=0)
            total[:, 2:] += miss.T @ x
            n += len(x)
        if n:
            yield passes.chunks(0, n, (total / n).ravel())

    _, flat = passes.run(rows, work)[0]
    sent.destroy()
    found = flat.reshape(len(points), -1)
    return found[:, 0], found[:, 1:]
