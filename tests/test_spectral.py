"""Principal components by products only, against the whole covariance."""

import numpy as np
import pandas as pd
import pytest

from rareflow.models import spectral
from rareflow.models.spectral import CentredPCA, leading_pairs


def symmetric(values, seed=1):
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize("values", [
    0.97 ** np.arange(300), np.ones(300) + np.arange(300)[::-1] / 1000,
    np.append([5.0, 5.0, 5.0], np.ones(297))])
def test_pairs_of_wide_matrices_with_restarts(values):
    full = symmetric(values)
    found, vectors, norms = leading_pairs(lambda block: full @ block, 300, 3, most=2000)
    np.testing.assert_allclose(found, np.sort(values)[::-1][:3], rtol=1e-9)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(3), atol=1e-9)
    assert np.abs(full @ vectors - vectors * found).max() < 1e-8 and norms.max() < 1e-8


def test_rank_below_the_components_asked_for():
    full = symmetric(np.append([4.0, 1.0], np.zeros(198)))
    found, vectors, _ = leading_pairs(lambda block: full @ block, 200, 4)
    np.testing.assert_allclose(found, [4, 1, 0, 0], atol=1e-9)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(4), atol=1e-9)


def test_no_settling_is_an_error():
    full = symmetric(1 + np.arange(300) / 1e6)
    with pytest.raises(RuntimeError):
        leading_pairs(lambda block: full @ block, 300, 2, most=2)


def test_wide_columns_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCKS", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 120)) * 0.9 ** np.arange(120) + 7
    rows = [(v.tolist(),) for v in x] + [(None,)]
    pca = CentredPCA(spark.createDataFrame(rows, "features array<double>").repartition(5), k=2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(pca.values, values[:2], rtol=1e-8)
    np.testing.assert_allclose(pca.ratios, values[:2] / values.sum(), rtol=1e-8)
    assert pca.residuals.max() <= 1e-9 * values[0]


def test_a_column_that_does_not_vary(spark):
    df = spark.createDataFrame(pd.DataFrame({"features": [[1.0, 2.0]] * 5}))
    pca = CentredPCA(df, k=2)
    np.testing.assert_allclose(pca.values, [0, 0], atol=1e-12)
    np.testing.assert_allclose(pca.ratios, [0, 0])
