"""Drawn settings, the halving rule, and trials that do not depend on the order of threads."""

import math

import numpy as np
import pandas as pd
import pytest

from rareflow.models import kernel
from rareflow.models.dan import DisguiseClassifier, Training
from rareflow.models.kernel import Shape
from rareflow.models.search import drawn_settings, halving, log_uniform, rung_table, survivors


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0.7).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"features": list(x), "label": y, "n": range(400)}))
    return df.where("n % 4 > 0"), df.where("n % 4 = 0")


def test_draws_are_log_uniform():
    ranges = {"lambd": (0.01, 10.0), "eta": (0.05, 2.0)}
    drawn = drawn_settings(2000, ranges)
    assert drawn == drawn_settings(2000, ranges) and drawn[:5] == drawn_settings(5, ranges)
    for name, (low, high) in ranges.items():
        logs = np.array([math.log(d[name] / low) / math.log(high / low) for d in drawn])
        assert logs.min() >= 0 and logs.max() < 1
        counts = np.histogram(logs, 10, (0, 1))[0]
        assert abs(counts - 200).max() < 60
    with pytest.raises(ValueError):
        log_uniform(0.0, 1.0, "eta", 1)


def test_survivors():
    assert survivors({0: 0.5, 1: 0.9, 2: 0.5, 3: 0.7}, 2) == [1, 3]
    assert survivors({0: 0.5, 1: 0.5, 2: 0.5}, 2) == [0, 1]
    assert survivors({4: float("nan"), 5: 0.1, 6: 0.2}, 3) == [6]
    assert survivors({7: 0.3}, 2) == [7]


def test_halving_follows_its_rule(spark, tables):
    shape, training = Shape(3, (4,), (4,)), Training(epochs=1, sync="gradient", learning_rate=0.05,
                                                   dtype="float64")
    settings = drawn_settings(5, {"lambd": (0.1, 2.0), "eta": (0.1, 2.0)})
    results = [halving(*tables, shape, training, settings, side_by_side=n) for n in (1, 3)]
    assert results[0][1] == results[1][1]
    np.testing.assert_array_equal(results[0][0].flat, results[1][0].flat)
    rows = rung_table(spark, results[0][1]).collect()
    alive = {i for i in range(5)}
    for rung, size in enumerate((5, 3, 2, 1)):
        now = [r for r in rows if r["rung"] == rung]
        assert {r["trial"] for r in now} == alive and len(now) == size
        assert {r["epochs"] for r in now} == {2 ** (rung + 1) - 1}
        on = {r["trial"] for r in now if r["goes_on"]}
        assert on == (set(survivors({r["trial"]: r["score"] for r in now}, 2)) if size > 1 else set())
        alive = on or alive
    # a trial that went on equals one trained in one go
    (number,), steps = alive, 2 ** 4 - 1
    alone = DisguiseClassifier(shape, Training(epochs=steps, sync="gradient", learning_rate=0.05,
                                               dtype="float64", **settings[number])).fit(tables[0])
    np.testing.assert_allclose(results[0][0].flat, alone.flat, rtol=1e-9)


def test_impossible_search(tables):
    with pytest.raises(ValueError):
        halving(*tables, Shape(3, (4,), (4,)), Training(), [])


@pytest.mark.parametrize("own", [("tanh", False), ("sigmoid", True)])
def test_networks_have_settings_of_their_own(own):
    activation, norm = own
    shape = Shape(3, (4,), (5,), activation="elu", batch_norm=not norm, disguise_activation=activation,
                  disguise_batch_norm=norm)
    names = [n for n, _ in shape.blocks()]
    assert ("t0g" in names) is norm and ("d0g" in names) is not norm
    rng = np.random.default_rng(0)
    flat, x = kernel.initial_weights(shape, 1) + 0.01, rng.normal(size=(6, 3))
    blocks = lambda f: kernel.as_blocks(shape, f)

    def loss(f, net):
        entropy, quality, change, _, _ = kernel.disguise_terms(shape, blocks(f), x, 0.5, 0.25)
        return 0.5 * change - quality if net == "t" else 0.25 * entropy

    grad = kernel.disguise_terms(shape, blocks(flat), x, 0.5, 0.25)[-1]
    mask = kernel.disguise_mask(shape)
    for i in range(len(flat)):
        net, up, down = "t" if mask[i] else "d", flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert grad[i] == pytest.approx((loss(up, net) - loss(down, net)) / 2e-6, abs=1e-5)
    z = x @ blocks(flat)["t0w"] + blocks(flat)["t0b"]
    a = kernel.ACTIVATIONS[activation][0](z)
    a = a * kernel.NORM * blocks(flat)["t0g"] + blocks(flat)["t0s"] if norm else a
    np.testing.assert_allclose(kernel.disguised(shape, blocks(flat), x),
                               a @ blocks(flat)["t1w"] + blocks(flat)["t1b"])
