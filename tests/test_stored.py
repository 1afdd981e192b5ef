"""Embeddings in a table: equal to dense weights, step by step."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.models import kernel
from rareflow.models.dan import Training, full_gradient
from rareflow.models.kernel import Adam, Shape
from rareflow.models.stored import attach, fit_stored, gradient, initial_store, unmoved
from rareflow.operators import encode

MAP = {1: 6, 3: 40}
DENSE = Shape(4, (5,), (6,), index_map=MAP)
STORED = Shape(4, (5,), (6,), index_map=MAP, stored=(3,))


def data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n),
                         np.minimum(rng.zipf(1.6, n), 40) - 1]).astype(float)
    y = (x[:, 0] + 0.3 * (x[:, 3] > 5) > 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"features": list(x), "label": y}))
    return df.withColumn("label", F.col("label").cast("int"))


def split(flat):
    """Dense weights as (weights without the stored embedding, its vectors)."""
    blocks = kernel.as_blocks(DENSE, flat)
    rest = np.concatenate([b.ravel() for name, b in blocks.items() if name != "e3"])
    return rest, blocks["e3"].copy()


def as_store(spark, vectors):
    return unmoved(spark.createDataFrame(
        [(3, i, [float(v) for v in row]) for i, row in enumerate(vectors)],
        "position int, code long, vector array<double>"))


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_dense_training(spark, monkeypatch, broadcast):
    """Codes that steps skip end where dense Adam leaves them."""
    if not broadcast:
        monkeypatch.setattr(encode, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(encode.dictionary_join, "__defaults__", (-1,))
    training = Training(lambd=0.5, eta=0.25, epochs=2, dtype="float64", learning_rate=0.05)
    df, flat = data(spark), kernel.initial_weights(DENSE, 3)
    rest, vectors = split(flat)
    model = fit_stored(df, STORED, training, rounds=4, store=as_store(spark, vectors), flat=rest)

    part = F.pmod(F.xxhash64(F.col("features").cast("string"), "label"), F.lit(4)).cast("int")
    adam, want = Adam(0.05), flat.copy()
    for _ in range(2):
        for k in range(4):
            step, losses = full_gradient(df.where(part == k), DENSE, training, want)
            adam.step(want, step)
    rest, vectors = split(want)
    np.testing.assert_allclose(model.flat, rest, rtol=1e-8, atol=1e-10)
    got = {r["code"]: r["vector"] for r in model.vectors().collect()}
    np.testing.assert_allclose([got[i] for i in range(40)], vectors, rtol=1e-8, atol=1e-10)
    assert {t: v for s, t, v in model.log if s == 8} == pytest.approx(losses)
    steps = {r["step"] for r in model.store.collect()}
    assert 0 in steps or len(steps) > 1                     # some codes skipped steps

    scored = model.score(df).select("features", "score").collect()
    x = np.array([r["features"] for r in scored])
    np.testing.assert_allclose([r["score"] for r in scored], kernel.positive_probability(
        DENSE, kernel.as_blocks(DENSE, want), x), rtol=1e-7)


def test_plain_classifier_and_partitions(spark):
    shape = Shape(4, (5,), None, index_map=MAP, stored=(1, 3))
    training = Training(epochs=2, dtype="float64", use_disguise=False)
    df = data(spark)
    one = fit_stored(df.repartition(1), shape, training, rounds=2)
    two = fit_stored(df.repartition(6), shape, training, rounds=2)
    np.testing.assert_allclose(one.flat, two.flat, rtol=1e-9, atol=1e-12)
    rows = lambda m: {(r[0], r[1]): r[2] for r in m.vectors().collect()}
    one, two = rows(one), rows(two)
    assert one.keys() == two.keys() and len(one) == 46
    for key in one:
        np.testing.assert_allclose(one[key], two[key], rtol=1e-9, atol=1e-12)


def test_initial_vectors(spark):
    shape = Shape(4, (5,), None, index_map=MAP, stored=(1, 3))
    store = initial_store(spark, shape, 5).collect()
    assert len(store) == 46 and {len(r["vector"]) for r in store if r["position"] == 3} == {4}
    values = np.concatenate([r["vector"] for r in store if r["position"] == 3])
    edge = np.sqrt(6 / 44)
    assert np.abs(values).max() <= edge and abs(values.mean()) < edge / 3
    assert initial_store(spark, shape, 5).collect() == store


def test_no_limit_on_stored_codes():
    big = Shape(2, (4,), None, index_map={1: 10 ** 9}, stored=(1,))
    assert big.size < 10 ** 5 and big.width == 1 + 1000


def test_unknown_codes_are_zeros(spark):
    df = spark.createDataFrame([([0.5, 1.0, 0.0, 999.0], 1), ([0.1, 2.0, 0.3, 3.0], 0)],
                               "features array<double>, label int")
    model = fit_stored(df, STORED, Training(epochs=1))
    assert model.store.count() == 40
    assert all(0 < r["score"] < 1 for r in model.score(df).collect())


def test_gradients_are_summed_in_a_hash_table(spark):
    """Vectors of several lengths are summed by column, and a row with one stored code is not joined again."""
    shape = Shape(4, (5,), None, index_map={1: 6, 3: 40}, stored=(1, 3))
    rows = data(spark).withColumn("row", F.monotonically_increasing_id())
    training = Training(dtype="float64", use_disguise=False)
    store = initial_store(spark, shape)
    _, found, _ = gradient(rows, store, shape, training, kernel.initial_weights(shape), Adam())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    dims = {p: shape.embedding_dim(n) for p, n in shape.index_map.items()}
    assert dims[1] != dims[3]
    got = found.collect()
    assert {r["position"] for r in got} == {1, 3}
    assert all(len(r["gradient"]) == dims[r["position"]] for r in got)
    assert all(v is not None for r in got for v in r["gradient"])
    one = Shape(4, (5,), None, index_map={3: 40}, stored=(3,))
    plan = attach(rows, store.where("position = 3"), one, Adam())._jdf.queryExecution() \
        .executedPlan().toString()
    assert "collect_list" not in plan
