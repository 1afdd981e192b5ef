"""Cleaning, roles and profiling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.functions.clean import tag_to_column
from rareflow.functions.scores import predicted_class, softmax_positive
from rareflow.operators import clean, matrix, profile


@pytest.fixture()
def wide(spark):
    rows = [(f"v{i % 30}", f"w{i % 3}", None if i % 4 else 1.5 * i, 1.0, None, i % 10 == 0)
            for i in range(300)]
    return spark.createDataFrame(
        rows, "big string, small string, x double, column_weights double, empty string, t boolean"
    ).withColumn("conversion_target", F.col("t").cast("int")).drop("t")


def test_cardinality_skips_nulls(wide):
    got = {r["column"]: r["cardinality"] for r in
           profile.cardinality_profile(wide, wide.columns).collect()}
    assert got == {"big": 30, "small": 3, "x": 75, "column_weights": 1, "empty": 0,
                   "conversion_target": 2}


def test_roles_cover_all_columns(wide):
    p = profile.cardinality_profile(wide, wide.columns)
    spec = clean.assign_roles(p, ["big", "small", "empty"], ["x"], ["column_weights"])
    assert spec.drop == ["column_weights", "empty"]
    assert spec.index == ["big"] and spec.onehot == ["small"] and spec.continuous == ["x"]
    with pytest.raises(ValueError):
        clean.assign_roles(p, ["big"], ["x"], ["column_weights"])
    roles = {r["column"]: r["role"] for r in clean.role_table(p, spec).collect()}
    assert roles["big"] == "index" and roles["empty"] == "drop"


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(str(i % 20), str(i % 21)) for i in range(500)],
                               "a string, b string")
    spec = clean.assign_roles(profile.cardinality_profile(df, df.columns), ["a", "b"], [])
    assert spec.onehot == ["a"] and spec.index == ["b"]


def test_constant_and_all_null_columns_go(wide):
    assert clean.drop_constant_columns(wide).columns == ["big", "small", "x", "conversion_target"]


def test_continuous_families():
    columns = ["id_vintage", "a_bpr", "a_bpr_x", "pixel_1", "site_pixel", "b_bpf", "other"]
    assert clean.continuous_columns(columns) == columns[:-1]
    assert clean.continuous_columns(columns, "suffix") == [
        "id_vintage", "a_bpr", "site_pixel", "b_bpf"]


def test_column_order(wide):
    assert clean.order_columns(wide, "conversion_target").columns == [
        "big", "column_weights", "empty", "small", "x", "conversion_target"]


def test_casts_truncate(spark):
    df = spark.createDataFrame([(-2.7,), (2.7,)], "x double")
    assert sorted(r["x"] for r in clean.cast_numeric_int(df, ["x"]).collect()) == [-2, 2]


def test_tie_at_the_threshold_is_positive_in_both_columns(spark):
    row = spark.range(1).select(predicted_class(F.lit(0.5)).alias("a"),
                                softmax_positive(F.lit(2.0), F.lit(2.0)).alias("b")).first()
    assert row["a"] == 1 and row["b"] == 0.5


def test_tag_names(spark):
    df = spark.createDataFrame([("Dan/Validation_AUROC",)], "tag string")
    assert df.select(tag_to_column(F.col("tag"))).first()[0] == "Validation auroc"


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"x": np.random.default_rng(0).normal(size=501)})
    row = profile.describe_numeric(spark.createDataFrame(pdf), ["x"]).first()
    want = pdf["x"].describe()
    for ours, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert row[ours] == pytest.approx(want[theirs])


def test_vocabulary_is_sorted_text(spark):
    df = spark.createDataFrame([("10",), ("-1",), ("2",), ("2",), (None,)], "c string")
    rows = profile.build_vocabulary(df, ["c"]).orderBy("idx").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("-1", 1), ("10", 1), ("2", 2)]


def test_merged_vocabulary_keeps_codes(spark):
    old = profile.build_vocabulary(spark.createDataFrame([("b",), ("d",)], "c string"), ["c"])
    new = profile.merge_vocabulary(
        old, spark.createDataFrame([("a",), ("b",), ("e",)], "c string"), ["c"])
    got = {r["value"]: r["idx"] for r in new.collect()}
    assert got == {"b": 0, "d": 1, "a": 2, "e": 3}


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(3).normal(size=1000)
    got = {r["bin"]: r["n"] for r in profile.histogram(
        spark.createDataFrame(pd.DataFrame({"x": values})), "x", 20).collect()}
    want = np.histogram(values, 20)[0]
    assert [got.get(i, 0) for i in range(20)] == want.tolist()


def test_null_profile_lists_only_gaps(wide):
    got = {r["column"]: r["nulls"] for r in profile.null_profile(wide, wide.columns).collect()}
    assert got == {"x": 225, "empty": 300}


def test_matrix_operators(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.1, 3.0]), ([2.0, 2.0], [2.0, 0.0])],
                               "a array<double>, b array<double>")
    df = df.withColumn("d", matrix.abs_diff("a", "b"))
    d = np.array([[0.1, 2.0], [0.0, 2.0]])
    clipped = np.clip(d, 0, 0.2)
    got = matrix.clip_rescale(df, "d").collect()
    np.testing.assert_allclose([r["d"] for r in got], (clipped - clipped.min()) / clipped.max())
    logged = np.log(np.log(d - d.min() + 1) + 1)
    got = matrix.double_log_scale(df, "d").collect()
    np.testing.assert_allclose([r["d"] for r in got], (logged - logged.min()) / logged.max())
    assert matrix.cell_limits(df, "d").first()["mean"] == pytest.approx(d.mean())


def test_describe_keeps_columns_and_models_without_values(spark):
    rows = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("m", None, None)],
                                 "model string, x double, y double")
    got = {r["column"]: r for r in profile.describe_numeric(rows, ["x", "y"]).collect()}
    assert got["x"]["n"] == 2 and got["x"]["q50"] == 2.0
    assert got["y"]["n"] == 0 and got["y"]["mean"] is None
    trials = {r["model"]: r["trials"] for r in profile.trial_summary(rows, "model", "x").collect()}
    assert trials == {None: 2, "m": 0}


def test_tags_of_any_length(spark):
    long = "x" * 1_000_010
    got = spark.createDataFrame([("a/b_c",), (long,), ("",), (None,)], "t string").select(
        tag_to_column(F.col("t"))).collect()
    assert [r[0] for r in got] == ["B c", "X" + long[1:], "", None]


def test_cardinality_counts_numbers_as_numbers(spark):
    """Large integers stay apart, both zeros are one value, and no number becomes text."""
    rows = [(2**53, 0.0, 1, "a", None), (2**53 + 1, -0.0, 2, "b", None), (2**53 + 1, 1.5, 2, None, None)]
    df = spark.createDataFrame(rows, "big bigint, x double, n int, s string, none double")
    found = profile.cardinality_profile(df, df.columns)
    assert {r["column"]: r["cardinality"] for r in found.collect()} == {
        "big": 2, "x": 2, "n": 2, "s": 2, "none": 0}
    assert "as string" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_impressions_join_the_numbers_of_lines(spark):
    """Keys and texts of lines are not shuffled: they are made behind the join."""
    from rareflow.sources.tables import impressions

    df = impressions(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5(") < plan.index("Join Inner") and "md5(" not in plan[plan.index("Join Inner"):]
