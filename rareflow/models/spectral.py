"""Leading principal components of wide columns, without a covariance matrix.

A pass multiplies the covariance by a block of vectors: each task adds up
``X'(XQ)`` of its centred rows. The driver holds a basis of ``width x basis`` numbers, never
``width x width``, and takes from it the vectors nearest to eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from rareflow.models import passes
from rareflow.session import materialize

OVERSAMPLING = 8             # vectors of a block beyond twice those asked for
BLOCKS = 8                   # blocks of a basis before it is restarted


def covariance_product(rows: DataFrame, features: str, mean: np.ndarray, block: np.ndarray
                       ) -> np.ndarray:
    """Sample covariance of ``features`` times ``block``, in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast((mean, block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, q = sent.value
        n, total = 0, np.zeros_like(q)
        for batch in batches:
            x = passes.matrix(batch, features) - centre
            total += x.T @ (x @ q)
            n += len(x)
        if n:
            yield passes.chunks(0, n, (total / n).ravel())

    n, product = passes.run(rows.select(features), work)[0]
    sent.destroy()
    return product.reshape(block.shape) * (n / max(n - 1, 1))


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, k: int,
                  tolerance: float = 1e-10, most: int = 200, seed: int = 0
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the ``k`` largest eigenvalues of a symmetric
    product, by block Krylov spaces that are restarted from their best vectors.

    Ends when all residuals are at most ``tolerance`` times the largest value; a basis as wide
    as the space is exact. More than ``most`` passes are an error.
    """
    size = min(width, 2 * k + OVERSAMPLING)
    limit = min(width, BLOCKS * size)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    for _ in range(most):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = turn[:, ::-1][:, :size]
        values, vectors, moved = values[::-1][:size], basis @ best, image @ best
        rest = moved - vectors * values
        norms = np.linalg.norm(rest, axis=0)
        floor = tolerance * max(values[0], 0.0)
        if basis.shape[1] == width or np.all(norms[:k] <= floor):
            return values[:k], vectors[:, :k], norms[:k]
        if basis.shape[1] + size > limit and limit < width:
            basis, image = vectors, moved
        block = rest[:, norms > floor]
        block = block / np.linalg.norm(block, axis=0)
        for _ in range(2):                       # once more against what rounding left over
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        block = block[:, :width - basis.shape[1]]
    raise RuntimeError(f"components did not settle within {most} passes")


class CentredPCA:
    """Principal components projected after centring; the largest weight of each is positive.

    ``values`` are the variances along them, ``ratios`` their shares of the total, ``residuals``
    the lengths of C v - value v. Rows without a vector take no part.
    """

    def __init__(self, df: DataFrame, features: str = "features", k: int = 2,
                 tolerance: float = 1e-10):
        rows = materialize(df.where(F.col(features).isNotNull()).select(
            F.col(features).cast("array<double>").alias("features")), "pca")
        spread = rows.select(Summarizer.metrics("mean", "variance").summary(
            array_to_vector("features")).alias("s")).first()["s"]
        self.mean, total = spread["mean"].toArray(), float(spread["variance"].toArray().sum())
        self.values, vectors, self.residuals = leading_pairs(
            lambda block: covariance_product(rows, "features", self.mean, block),
            len(self.mean), k, tolerance)
        lead = vectors[np.abs(vectors).argmax(axis=0), range(k)]
        self.components = vectors * np.where(lead < 0, -1.0, 1.0)
        self.ratios = self.values / total if total else np.zeros(k)
        self.features, self.k = features, k

    def project(self, df: DataFrame, features: str | None = None) -> DataFrame:
        """Adds pc1 .. pck by column arithmetic."""
        values = F.col(features or self.features).cast("array<double>")
        outs = {}
        for j in range(self.k):
            weights = self.components[:, j]
            terms = F.zip_with(values, F.array(*[F.lit(float(v)) for v in weights]),
                               lambda a, b: a * b)
            outs[f"pc{j + 1}"] = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) \
                - F.lit(float(self.mean @ weights))
        return df.withColumns(outs)
