"""Losses, training, checkpoints and baselines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.models import baselines, kernel
from rareflow.models.dan import (
    DisguiseClassifier, DisguiseModel, Training, load_checkpoint, save_checkpoint)
from rareflow.models.kernel import Shape
from rareflow.models.spectral import CentredPCA
from rareflow.sources import generators

SMALL = Shape(4, (5, 3), (6,), "tanh", True, {1: 7, 3: 9})


def batch(n=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1], x[:, 3] = rng.integers(0, 7, n), rng.integers(0, 9, n)
    return x, (rng.random(n) < 0.4).astype(int)


def numeric(loss, flat, eps=1e-6):
    out = np.zeros_like(flat)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        out[i] = (loss(up) - loss(down)) / (2 * eps)
    return out


@pytest.mark.parametrize("activation", list(kernel.ACTIVATIONS))
def test_gradients(activation):
    shape = Shape(**{**SMALL.__dict__, "activation": activation})
    x, y = batch()
    rng = np.random.default_rng(3)
    flat = kernel.initial_weights(shape, 1) + 0.05 * rng.normal(size=shape.size)
    lambd, eta = 0.7, 0.3
    blocks = lambda f: kernel.as_blocks(shape, f)
    mask = kernel.disguise_mask(shape)
    _, grad = kernel.labelled_terms(shape, blocks(flat), x, y)
    want = numeric(lambda f: kernel.labelled_terms(shape, blocks(f), x, y)[0], flat)
    np.testing.assert_allclose(grad, want, atol=1e-5)
    negatives = x[y == 0]
    grad = kernel.disguise_terms(shape, blocks(flat), negatives, lambd, eta)[-1]

    def entropy(f):
        return eta * kernel.disguise_terms(shape, blocks(f), negatives, lambd, eta)[0]

    def disguise(f):
        _, quality, change, _, _ = kernel.disguise_terms(shape, blocks(f), negatives, lambd, eta)
        return -quality + lambd * change

    np.testing.assert_allclose(grad[~mask], numeric(entropy, flat)[~mask], atol=1e-5)
    np.testing.assert_allclose(grad[mask], numeric(disguise, flat)[mask], atol=1e-5)


def test_embedded_width():
    shape = Shape(8, (4,), (4,), index_map={4: 200, 5: 100, 6: 80, 7: 50})
    assert shape.width == 24
    x = np.zeros((3, 8))
    w = kernel.as_blocks(shape, kernel.initial_weights(shape))
    assert kernel.disguised(shape, w, x).shape == (3, 24)


@pytest.fixture(scope="module")
def gaussians(spark):
    df = generators.two_gaussians(generators.row_keys(spark, 3000), "row_key", 0.2)
    return df.select(F.array("x0", "x1").alias("features"), "label").persist()


def test_full_pass_steps_do_not_depend_on_partitions(gaussians):
    fit = lambda n: DisguiseClassifier(
        Shape(2, (4,), (4, 6, 4)), Training(epochs=3, sync="gradient", workers=n,
                                            dtype="float64")).fit(gaussians)
    a, b = fit(1), fit(5)
    np.testing.assert_allclose(a.flat, b.flat, atol=1e-8)
    assert [t for _, t, _ in a.log[:7]] == [
        "cross entropy", "predictive entropy", "discriminator loss", "disguise quality",
        "disguise success rate", "regularizer", "disguise loss"]


def test_training_learns(gaussians):
    model = DisguiseClassifier(Shape(2, (8,), batch_norm=False), Training(
        epochs=6, learning_rate=1e-2, batch_size=32, workers=2)).fit(gaussians)
    assert model.evaluate(gaussians)["auroc"] > 0.8


def test_predictions_have_the_right_shape(gaussians):
    model = DisguiseModel(Shape(2, (4, 4), (4, 6, 4)),
                          kernel.initial_weights(Shape(2, (4, 4), (4, 6, 4))))
    both = model.predict_proba(gaussians)
    assert both.filter(F.abs(F.col("proba_negative") + F.col("proba_positive") - 1) > 1e-9) \
        .count() == 0
    pred = model.predict(gaussians)
    assert pred.count() == 3000
    # a probability of exactly one half marks both classes
    ties = both.filter("proba_positive = 0.5").count()
    assert pred.filter("negative + positive = 2").count() == ties
    assert pred.filter("negative + positive = 1").count() == 3000 - ties
    moved = model.disguise(gaussians.filter("label = 0"))
    assert moved.select(F.max(F.size("disguised"))).first()[0] == 2


def test_disguise_needs_a_network(gaussians):
    model = DisguiseModel(Shape(2, (4,)), kernel.initial_weights(Shape(2, (4,))))
    with pytest.raises(AttributeError):
        model.disguise(gaussians)


def test_native_logistic_score_equals_the_kernel(gaussians):
    shape = Shape(2, (), batch_norm=False)
    model = DisguiseModel(shape, kernel.initial_weights(shape, 4))
    rows = model.transform(gaussians.limit(50)).collect()
    want = kernel.positive_probability(shape, kernel.as_blocks(shape, model.flat),
                                       np.array([r["features"] for r in rows]))
    np.testing.assert_allclose([r["score"] for r in rows], want)


def test_single_class_trains(spark):
    df = generators.two_gaussians(generators.row_keys(spark, 300), "row_key", 0.0).select(
        F.array("x0", "x1").alias("features"), "label")
    model = DisguiseClassifier(Shape(2, (4,), (4,)), Training(epochs=1, workers=2)).fit(df)
    assert np.isfinite(model.flat).all()


def test_regularisation_strength(gaussians):
    def last(lambd, tag):
        model = DisguiseClassifier(
            Shape(2, (4,), (8,), batch_norm=False),
            Training(lambd=lambd, eta=0.0, epochs=4, learning_rate=1e-2, batch_size=32,
                     workers=2)).fit(gaussians)
        return [v for _, t, v in model.log if t == tag][-1]

    assert last(50.0, "regularizer") < last(0.0, "regularizer")
    assert last(0.0, "disguise success rate") > last(50.0, "disguise success rate")


def test_embeddings_train(spark):
    df = generators.mixed_table(generators.row_keys(spark, 800), "row_key", 2, (20, 30))
    rows = df.select(F.array("c0", "c1", "k0", "k1").cast("array<double>").alias("features"),
                     (F.col("k0") < 5).cast("int").alias("label"))
    shape = Shape(4, (8,), (8,), index_map={2: 20, 3: 30})
    model = DisguiseClassifier(shape, Training(epochs=4, learning_rate=2e-2, batch_size=32,
                                               workers=2)).fit(rows)
    before = kernel.as_blocks(shape, kernel.initial_weights(shape, 0))["e2"]
    assert not np.allclose(before, kernel.as_blocks(shape, model.flat)["e2"])
    assert model.evaluate(rows)["auroc"] > 0.6


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "versions")
    assert load_checkpoint(spark, path) is None
    for step in (1, 2, 3, 10, 11):
        save_checkpoint(spark, path, np.arange(4.0) + step, step, step / 100)
    flat, step, best = load_checkpoint(spark, path)[:3]
    assert step == 11 and best == 0.11 and flat[0] == 11
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == [
        "step=10", "step=11", "step=3"]


def test_training_resumes(spark, gaussians, tmp_path):
    path, shape = str(tmp_path / "resume"), Shape(2, (4,))
    first = DisguiseClassifier(shape, Training(epochs=1, workers=1), checkpoint_dir=path).fit(
        gaussians)
    second = DisguiseClassifier(shape, Training(epochs=1, workers=1), checkpoint_dir=path).fit(
        gaussians)
    assert second.log[0][0] == 2 and not np.allclose(first.flat, second.flat)


def test_early_stopping_keeps_the_best(gaussians):
    model = DisguiseClassifier(
        Shape(2, (8,)), Training(epochs=15, learning_rate=0.3, batch_size=16, workers=2,
                                 early_stopping=2), validation=gaussians).fit(gaussians)
    aurocs = [v for _, t, v in model.log if t == "validation auroc"]
    best = int(np.argmax(aurocs))
    assert len(aurocs) <= best + 3
    assert model.evaluate(gaussians)["auroc"] == pytest.approx(max(aurocs))


def test_model_round_trip(spark, tmp_path):
    model = DisguiseModel(SMALL, kernel.initial_weights(SMALL, 2))
    model.save(str(tmp_path / "model"))
    again = DisguiseModel.load(spark, str(tmp_path / "model"))
    assert again.shape == model.shape and np.allclose(again.flat, model.flat)


def test_gaussian_nb(gaussians):
    df = gaussians.select("label", F.col("features")[0].alias("x0"),
                          F.col("features")[1].alias("x1"))
    p = baselines.gaussian_nb(df, ["x0", "x1"], "label", (0.8, 0.2))
    accuracy = df.agg(F.avg(((p >= 0.5) == (F.col("label") == 1)).cast("int"))).first()[0]
    assert accuracy > 0.8


def test_logistic_optimum(gaussians):
    """At the optimum the penalised gradient vanishes."""
    n, c = 3000, 0.5
    model = baselines.logistic_regression(baselines.as_vector(gaussians), "label", c=c)
    pdf = gaussians.toPandas()
    x, y = np.stack(pdf["features"]), pdf["label"].to_numpy()
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / n + w / (c * n)).max() < 1e-4
    assert abs((p - y).mean()) < 1e-4


def test_pca_is_centred_and_uncorrelated(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) @ np.diag([3, 2, 1, 0.5]) + 10
    df = spark.createDataFrame(pd.DataFrame({"features": list(x)}))
    pca = CentredPCA(df, k=2)
    out = pca.project(df).select("pc1", "pc2").toPandas().to_numpy()
    np.testing.assert_allclose(out.mean(axis=0), 0, atol=1e-8)
    assert abs(np.corrcoef(out.T)[0, 1]) < 1e-8
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(pca.ratios, (values / values.sum())[:2])
    np.testing.assert_allclose(out.var(axis=0, ddof=1), values[:2])


def test_tuning_ranks_penalties(gaussians):
    train = baselines.as_vector(gaussians)
    rows = baselines.tune_on_validation(train, train, "label", grid=[0.001, 1.0]).collect()
    assert len(rows) == 2 and rows[0]["auroc"] >= rows[1]["auroc"]


def test_experiment_records_result_and_log(spark, gaussians, tmp_path):
    from rareflow.models.experiment import run_experiment
    _, result = run_experiment(
        "r1", gaussians, gaussians, gaussians, Shape(2, (4,), (4,)),
        Training(epochs=2, workers=2), oversample_times=3, checkpoint_dir=str(tmp_path / "c"),
        results_dir=str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out/results")).first()
    assert row["run_id"] == "r1" and row["oversample"] == 3 and row["lambd"] == 1.0
    assert row["auroc"] == pytest.approx(result.first()["auroc"])
    log = spark.read.parquet(str(tmp_path / "out/log"))
    best = log.filter("tag = 'validation auroc'").agg(F.max("value")).first()[0]
    assert row["best_validation_auroc"] == best
