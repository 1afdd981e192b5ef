"""Merging in two levels, and several merges an epoch."""

import io
from contextlib import redirect_stdout
from dataclasses import replace

import numpy as np
import pytest

from rareflow.models import passes
from rareflow.models.dan import DisguiseClassifier, Training, training_rows
from rareflow.models.kernel import Shape

FULL = Training(epochs=2, sync="gradient", dtype="float64", learning_rate=0.05)
SHAPE = Shape(2, (3,), batch_norm=False)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 1).astype(int)
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "id int, features array<double>, label int")


def parts(spark, tasks=9, width=3):
    def work(batches):
        for batch in batches:
            for n in batch.column("id").to_pylist():
                yield passes.chunks(0, n + 1.0, np.arange(width) * float(n))
    return spark.range(0, tasks, 1, tasks).mapInArrow(work, passes.CHUNK_SCHEMA)


@pytest.mark.parametrize("lanes", [1, 2, 3, 20])
def test_levels_do_not_change_the_mean(spark, lanes, monkeypatch):
    got = passes.merged(parts(spark), lanes).collect()
    weights = np.arange(9) + 1.0
    assert [(r["kind"], r["chunk"], r["weight"]) for r in got] == [(0, 0, 45.0)]
    np.testing.assert_allclose(got[0]["mean"], np.arange(3) * (weights @ np.arange(9)) / 45)


def test_the_plan_has_two_levels(spark):
    def exchanges(lanes):
        text = io.StringIO()
        with redirect_stdout(text):
            passes.merged(parts(spark), lanes).explain()
        return text.getvalue().count("Exchange hashpartitioning")
    assert (exchanges(1), exchanges(3)) == (1, 2)


def test_rounds_cut_the_rows_evenly_and_lose_none(rows):
    for key in (None, "id"):
        cut = training_rows(rows, "features", "label", 4, rounds=3, key=key)
        sizes = [r["count"] for r in cut.groupBy("round").count().collect()]
        assert len(sizes) == 3 and sum(sizes) == 500
        assert max(sizes) - min(sizes) <= (4 if key is None else 60)


def test_keyed_rounds_do_not_depend_on_partitions(rows):
    training = replace(FULL, rounds_per_epoch=3)
    first = DisguiseClassifier(SHAPE, training, key="id").fit(rows.repartition(1)).flat
    again = DisguiseClassifier(SHAPE, replace(training, workers=7), key="id").fit(rows).flat
    np.testing.assert_allclose(first, again, atol=1e-9)


def test_each_round_is_a_step(rows):
    one = DisguiseClassifier(SHAPE, FULL).fit(rows)
    many = DisguiseClassifier(SHAPE, replace(FULL, rounds_per_epoch=8), key="id").fit(rows)
    loss = lambda m: [v for _, tag, v in m.log if tag == "cross entropy"][-1]
    assert loss(many) < loss(one)


def test_more_rounds_than_rows(rows):
    few = rows.limit(2)
    model = DisguiseClassifier(SHAPE, replace(FULL, epochs=1, rounds_per_epoch=5), key="id").fit(few)
    assert np.isfinite(model.flat).all()
