"""Metrics against brute force."""

import numpy as np
import pandas as pd
import pytest

from rareflow.operators import metrics


@pytest.fixture()
def scored(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(1500) < 0.2).astype(int)
    p = np.clip(np.round(rng.random(1500) * 0.8 + 0.2 * y, 2), 0, 1)
    pdf = pd.DataFrame({"y": y, "score": p})
    return pdf, spark.createDataFrame(pdf)


def brute_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    return wins / (len(pos) * len(neg))


def brute_micro(y, p):
    y, p = np.concatenate([y, 1 - y]), np.concatenate([p, 1 - p])
    limits = [-1e-7, *[(i + 1) / 199 for i in range(198)], 1 + 1e-7]
    tp = np.array([((p > t) & (y == 1)).sum() for t in limits], float)
    fp = np.array([((p > t) & (y == 0)).sum() for t in limits], float)
    x, h = fp / ((y == 0).sum() + 1e-6), (tp + 1e-6) / ((y == 1).sum() + 1e-6)
    return ((x[:-1] - x[1:]) * (h[:-1] + h[1:]) / 2).sum()


@pytest.mark.parametrize("small", [5, 1_000_000])
def test_auroc(scored, small):
    pdf, df = scored
    want = brute_auroc(pdf["y"].to_numpy(), pdf["score"].to_numpy())
    assert metrics.auroc(df, slice_rows=small).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("small", [5, 1_000_000])
def test_average_precision(scored, small):
    pdf, df = scored
    y, p = pdf["y"].to_numpy(), pdf["score"].to_numpy()
    want, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (y[hit] == 1).sum() / y.sum()
        want += (recall - last) * (y[hit] == 1).mean()
        last = recall
    assert metrics.average_precision(df, slice_rows=small).first()[0] == pytest.approx(want)


def test_micro_auroc(scored):
    pdf, df = scored
    want = brute_micro(pdf["y"].to_numpy(), pdf["score"].to_numpy())
    assert metrics.auroc_micro(df).first()[0] == pytest.approx(want)


def test_thresholds_are_met_exactly(spark):
    limits = metrics.micro_thresholds()
    values = sorted({v for t in limits[1:-1] for v in
                     (t, np.nextafter(t, 0), np.nextafter(t, 1))} | {0.0, 1.0})
    df = spark.createDataFrame(pd.DataFrame({"p": values}))
    got = df.select("p", metrics.micro_bucket(df["p"]).alias("b")).collect()
    assert all(r["b"] == sum(t < r["p"] for t in limits) for r in got)


def test_constant_predictor_looks_good_only_in_the_micro_form(spark):
    pdf = pd.DataFrame({"y": [1] * 12 + [0] * 9988, "score": 0.0012})
    row = metrics.score_summary(spark.createDataFrame(pdf)).first()
    assert row["auroc"] == pytest.approx(0.5)
    assert row["auroc_micro"] > 0.998 and row["accuracy"] > 0.998
    assert row["precision"] == 0 and row["recall"] == 0


def test_summary_equals_the_single_metrics(scored):
    _, df = scored
    row = metrics.score_summary(df).first().asDict()
    for part in (metrics.cross_entropy(df), metrics.accuracy(df), metrics.auroc(df),
                 metrics.auroc_micro(df), metrics.precision_recall_f1(df).drop("f1")):
        for name, value in part.first().asDict().items():
            assert row[name] == pytest.approx(value)


def test_tie_counts_half_right(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, score double")
    assert metrics.accuracy(df).first()[0] == 0.5


def test_class_report_and_confusion(scored):
    pdf, df = scored
    pred = (pdf["score"] >= 0.5).astype(int)
    rows = {r["label"]: r for r in metrics.class_report(df).collect()}
    for label in (0, 1):
        tp = ((pred == label) & (pdf["y"] == label)).sum()
        assert rows[label]["precision"] == pytest.approx(tp / (pred == label).sum())
        assert rows[label]["recall"] == pytest.approx(tp / (pdf["y"] == label).sum())
        assert rows[label]["support"] == (pdf["y"] == label).sum()
    shares = {(r["y"], r["predicted"]): r["share"] for r in metrics.confusion(df).collect()}
    assert sum(shares.values()) == pytest.approx(1)


def test_no_predicted_positive_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, score double")
    assert tuple(metrics.precision_recall_f1(df).first()) == (0.0, 0.0, 0.0)
