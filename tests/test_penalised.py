"""All penalties in the same passes: optimum, equality with single fits, ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.models import baselines
from rareflow.models.penalised import PenaltyPath, Walk
from rareflow.operators import metrics


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)) * [1, 100, 0.01, 0] + [0, 5000, 3, 2]
    p = 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 5000) / 200 - 1)))
    y = (rng.random(600) < p).astype(int)
    rows = [(v.tolist(), int(t)) for v, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "features array<double>, label int").repartition(3)


GRID = [1e-4, 0.1, 1.0, 1000.0]


def test_penalised_slopes_vanish(points):
    x, y, df = points
    path = PenaltyPath(df, "label", grid=GRID)
    for c, offset, weights in zip(path.grid, path.offsets, path.weights):
        miss = 1 / (1 + np.exp(-(x @ weights + offset))) - y
        slope = (x - x.mean(axis=0)).T @ miss / len(y) + weights / (c * len(y))
        assert np.abs(slope).max() < 1e-6 and abs(miss.mean()) < 1e-8
        assert weights[3] == 0
    assert path.passes < 60


def test_equals_single_fits(points):
    _, _, df = points
    path = PenaltyPath(df, "label", grid=[0.5])
    one = baselines.logistic_regression(baselines.as_vector(df), "label", c=0.5)
    np.testing.assert_allclose(path.weights[0], one.coefficients.toArray(), atol=1e-4)


def test_ranking_equals_one_by_one(points):
    _, _, df = points
    path = PenaltyPath(df, "label", grid=GRID)
    got = {r["c"]: r["auroc"] for r in path.auroc(df, "label").collect()}
    for at, c in enumerate(GRID):
        one = metrics.auroc(df.select(F.col("label").alias("y"), path.scores()[at].alias("score")))
        assert got[c] == pytest.approx(one.first()["auroc"], abs=1e-12)


def test_rows_without_features_or_label_take_no_part(spark, points):
    _, _, df = points
    more = df.unionByName(spark.createDataFrame(
        [(None, 1), ([1.0, 2.0, 3.0, 4.0], None)], df.schema))
    np.testing.assert_allclose(PenaltyPath(more, "label", grid=[1.0]).weights,
                               PenaltyPath(df, "label", grid=[1.0]).weights, atol=1e-8)


def test_one_class_has_no_ranking_and_no_rows_is_an_error(spark, points):
    _, _, df = points
    path = PenaltyPath(df, "label", grid=[1.0])
    assert path.auroc(df.where("label = 1"), "label").first()["auroc"] is None
    with pytest.raises(ValueError):
        PenaltyPath(df.limit(0), "label")


def test_a_walk_finds_the_bottom_of_a_narrow_bowl():
    stretch, bottom = np.geomspace(1e-2, 1e2, 8), np.linspace(-1, 1, 8)
    walk, passes = Walk(np.full(8, 5.0), 1e-9), 0
    while not walk.done:
        off, passes = walk.point - bottom, passes + 1
        walk.told(np.logaddexp(off, -off).sum() + stretch @ off ** 2, np.tanh(off) + 2 * stretch * off)
    np.testing.assert_allclose(walk.at, bottom, atol=1e-7)
    assert passes < 80
