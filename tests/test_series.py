"""Gap filling against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.operators import series


@pytest.fixture()
def gaps():
    rng = np.random.default_rng(7)
    frames = []
    for run in range(3):
        steps = np.sort(rng.choice(5000, 400, replace=False))
        values = rng.normal(size=(400, 2))
        values[rng.random((400, 2)) < 0.6] = np.nan
        values[:5, 0] = np.nan
        values[-6:, 1] = np.nan
        frames.append(pd.DataFrame({"run": run, "step": steps, "a": values[:, 0],
                                    "b": values[:, 1]}))
    return pd.concat(frames)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("a", "b")})


def compare(got, want):
    got = got.toPandas().sort_values(["run", "step"])[["a", "b"]].to_numpy(float)
    np.testing.assert_allclose(got, want[["a", "b"]].to_numpy(float))


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_interpolation(spark, gaps, small):
    got = series.interpolate_linear(to_spark(spark, gaps), ["run"], "step", ["a", "b"], small)
    want = gaps.groupby("run")[["a", "b"]].transform(lambda s: s.interpolate("linear"))
    compare(got, want)


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_backfill_and_fill(spark, gaps, small):
    df = to_spark(spark, gaps)
    compare(series.backfill(df, ["run"], "step", ["a", "b"], small),
            gaps.groupby("run")[["a", "b"]].transform(lambda s: s.bfill()))
    compare(series.fill_series(df, ["run"], "step", ["a", "b"], small),
            gaps.groupby("run")[["a", "b"]].transform(lambda s: s.interpolate("linear").bfill()))


def test_pivot_equals_outer_joins(spark):
    log = spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 3.0), (5, "c", 4.0)],
        "step int, tag string, value double")
    tags = ["a", "b", "c"]
    wide = series.pivot_series(log, ["step"], tags)
    joined = series.outer_join_series(
        [log.filter(F.col("tag") == t).select("step", F.col("value").alias(t)) for t in tags],
        ["step"])
    assert wide.exceptAll(joined.select(*wide.columns)).count() == 0 and joined.count() == 3


def test_log_union_and_range(spark):
    a = spark.createDataFrame([(1, 2.0)], "step int, x double")
    b = spark.createDataFrame([(300_000, 3.0)], "step int, y double")
    both = series.union_logs([a, b])
    assert set(both.columns) == {"step", "x", "y"}
    assert series.series_range(both, "step", 250_000, 400_000).count() == 1
    assert series.dropna_sort(both, ["x"], ["step"]).count() == 1


def test_best_score_without_logs(spark):
    log = spark.createDataFrame([], "tag string, value double")
    assert series.best_score(log, "validation auroc").first()[0] == float("-inf")


def test_no_frame_runs_to_the_end(spark, gaps):
    """Such frames are recomputed for every row: quadratic in the run's length."""
    for small in (50, 1_000_000):
        filled = series.fill_series(to_spark(spark, gaps), ["run"], "step", ["a", "b"], small)
        plan = filled._jdf.queryExecution().toString().lower()
        assert "currentrow$(), unboundedfollowing$()" not in plan


def test_slices_keep_series_without_a_name(spark):
    rows = spark.createDataFrame(
        [(None, 1, 1.0), (None, 2, None), (None, 4, 4.0), ("a", 1, None), ("a", 2, 7.0),
         ("a", 3, None)], "run string, step int, x double")
    one, many = (sorted(map(str, series.fill_series(rows, ["run"], "step", ["x"], size).collect()))
                 for size in (10 ** 9, 1))
    assert one == many and len(one) == 6
    got = {(r["run"], r["step"]): r["x"] for r in series.fill_series(
        rows, ["run"], "step", ["x"], 2).collect()}
    assert got[None, 2] == 2.5 and got["a", 1] == 7.0 and got["a", 3] == 7.0
