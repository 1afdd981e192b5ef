"""Exact ranks in hash and value order, also under heavy skew."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.operators.ordering import (
    HashOrder, counted_values, exact_quantiles, moments_and_quantiles, running_before)


def token(key, seed):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def expected_order(df, seed):
    rows = [r["row_key"] for r in df.select("row_key").collect()]
    return sorted(rows, key=lambda k: token(k, seed))


def test_take_is_the_hash_prefix(numbered):
    got = HashOrder(numbered, "row_key", "s").take(137)
    assert sorted(r["row_key"] for r in got.collect()) == sorted(
        expected_order(numbered, "s")[:137])


def test_take_does_not_depend_on_partitioning(numbered):
    a = HashOrder(numbered, "row_key", "s", "target").take({0: 50, 1: 20})
    b = HashOrder(numbered.repartition(7, "x"), "row_key", "s", "target").take({0: 50, 1: 20})
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == 70


def test_split_parts_make_up_the_table(numbered):
    first, rest = HashOrder(numbered, "row_key", "s", "target").split({0: 0, 1: 286})
    assert first.count() == 286 and rest.count() == 2000 - 286
    assert first.unionByName(rest).exceptAll(numbered).count() == 0


def test_too_large_a_sample_is_an_error(numbered):
    with pytest.raises(ValueError):
        HashOrder(numbered, "row_key", "s").take(2001)


def test_sampling_shuffles_no_rows(numbered):
    plan = HashOrder(numbered, "row_key", "s").take(100)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_positions_number_every_row(numbered):
    rows = HashOrder(numbered, "row_key", "s").positions().collect()
    by_position = [r["row_key"] for r in sorted(rows, key=lambda r: r["position"])]
    assert by_position == expected_order(numbered, "s")


@pytest.fixture()
def skewed(numbered):
    """A third of the rows share one key: half of those are exact copies."""
    hot = F.col("id") % 3 == 0
    return numbered.select(
        F.when(hot, F.lit("hot")).otherwise(F.col("row_key")).alias("row_key"), "target",
        F.when(hot & (F.col("id") % 2 == 0), F.lit(0)).otherwise(F.col("id")).alias("id"))


@pytest.mark.parametrize("k", [1, 500, 666, 1000, 1999, 2000])
def test_hot_key_samples_are_exact_and_whole(skewed, k):
    first, rest = HashOrder(skewed, "row_key", "s", hot_rows=50).split(k)
    assert first.count() == k and rest.count() == 2000 - k
    assert first.unionByName(rest).exceptAll(skewed).count() == 0


def test_hot_key_positions_equal_the_plain_ones(skewed):
    hot = HashOrder(skewed, "row_key", "s", hot_rows=50)
    assert hot.is_hot()
    rows = hot.positions()
    assert rows.agg(F.countDistinct("position")).first()[0] == 2000
    assert rows.agg(F.max("position")).first()[0] == 1999
    plain = HashOrder(skewed, "row_key", "s").positions().select("row_key", "position")
    assert rows.select("row_key", "position").exceptAll(plain).count() == 0
    assert rows.drop("position").exceptAll(skewed).count() == 0


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_running_totals_match_pandas(spark, small):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": rng.integers(0, 900, 3000)})
    counted = pdf.groupby(["g", "v"]).size().reset_index(name="n")
    got = running_before(spark.createDataFrame(counted), ["g"], "v", ["n"], small).toPandas()
    counted = counted.sort_values(["g", "v"])
    counted["n_before"] = counted.groupby("g")["n"].cumsum() - counted["n"]
    counted["n_total"] = counted.groupby("g")["n"].transform("sum")
    merged = got.merge(counted, on=["g", "v"], suffixes=("", "_want"))
    assert len(merged) == len(counted)
    assert (merged["n_before"] == merged["n_before_want"]).all()
    assert (merged["n_total"] == merged["n_total_want"]).all()


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_quantiles_match_pandas(spark, small):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 1001), "v": rng.normal(size=1001).round(2)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v",
                          {"a": 0.25, "b": 0.5, "c": 0.9}, small).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got.loc[[0, 1], ["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_rows_without_a_class_are_kept(numbered):
    gaps = numbered.withColumn("target", F.when(F.col("id") % 5 != 0, F.col("target")))
    order = HashOrder(gaps, "row_key", "s", "target")
    placed = order.positions()
    assert placed.count() == 2000
    missing = placed.filter("target is null")
    assert missing.count() == 400 and missing.agg(F.max("position")).first()[0] == 399
    first, rest = order.split({None: 100, 0: 10})
    assert first.filter("target is null").count() == 100 and first.count() == 110
    assert rest.filter("target is null").count() == 300


def sized(rows):
    return sorted(map(str, rows))


@pytest.fixture()
def gaps(spark):
    """Groups and values with NULLs, a NULL group of its own, a group without values."""
    rows = [(g, v) for g in ("a", None, "b") for v in (3.0, 1.0, None, 1.0, 2.5)] + [("c", None)]
    return spark.createDataFrame(rows, "g string, v double")


def test_slices_change_no_rows(spark, gaps):
    counted = gaps.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    quantiles = {"a": 0.25, "b": 0.5}
    one, many = ((sized(running_before(counted, ["g"], "v", ["n"], size).collect()),
                  sized(exact_quantiles(gaps, ["g"], "v", quantiles, size).collect()))
                 for size in (10 ** 9, 1))
    assert one == many
    assert len(one[0]) == 9 and len(one[1]) == 3


@pytest.mark.parametrize("by", [None, "target"])
def test_hot_limits_change_no_order(skewed, by):
    some = skewed.withColumn("target", F.when(F.col("id") % 5 != 0, F.col("target")))
    placed = [sized(HashOrder(some.repartition(p), "row_key", "s", by, hot_rows=size)
                    .positions().collect()) for p, size in ((3, 1), (5, 50), (2, 10 ** 9))]
    assert placed[0] == placed[1] == placed[2]


def test_one_key_for_all_rows_is_hot(spark):
    rows = spark.range(10_000).select(F.lit("k").alias("row_key"), "id")
    assert HashOrder(rows, "row_key", "s", hot_rows=50).is_hot()


def test_many_copies_are_cut_into_pieces(spark):
    from rareflow.operators import ordering
    rows = spark.createDataFrame([("x", 250_001), ("y", 0), ("z", 1)], "v string, times long")
    pieces = ordering.in_pieces(rows, "times").collect()
    assert sorted(r["times"] for r in pieces) == [1, 50_001, 100_000, 100_000]
    assert ordering.repeated(rows, "times").groupBy("v").count().orderBy("v").collect() == [
        ("x", 250_001), ("z", 1)]


@pytest.fixture()
def shapes(spark):
    """Groups with ties, heavy tails, one value, one row, extremes, and a NULL group."""
    rng = np.random.default_rng(7)
    parts = {"ties": rng.integers(0, 4, 3001).astype(float),
             "hot": np.concatenate([np.zeros(2000), rng.normal(size=999)]),
             "tails": 10.0 ** rng.uniform(-250, 250, 2000), "one": np.array([2.5]),
             "same": np.full(700, -1.0), None: rng.normal(size=1503),
             "ends": np.concatenate([rng.normal(size=300), [-1.7e308, 1.7e308]])}
    rows = [(g, float(x)) for g, v in parts.items() for x in v] + [("ties", None), ("empty", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5), parts


@pytest.mark.parametrize("accuracy,slices,groups", [
    (1000, 10 ** 6, 100), (100, 50, 100), (10 ** 6, 10 ** 6, 100), (1000, 10 ** 6, 2)])
def test_bracketed_quantiles_are_exact(shapes, accuracy, slices, groups):
    df, parts = shapes
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.502, "f": 0.999, "g1": 1.0}
    got = {r["g"]: r for r in
           moments_and_quantiles(df, ["g"], "v", probs, accuracy, slices, groups).collect()}
    assert set(got) == set(parts)
    want = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, slices).collect()}
    for g, v in parts.items():
        row = got[g]
        assert (row["n"], row["min"], row["max"]) == (len(v), v.min(), v.max())
        assert all(row[p] == want[g][p] for p in probs)
        if g not in ("ends", "tails"):
            assert row["mean"] == pytest.approx(v.mean(), abs=1e-9)
            np.testing.assert_allclose([row[p] for p in probs], np.quantile(v, list(probs.values())))
    assert got["one"]["std"] is None
    assert got["hot"]["std"] == pytest.approx(parts["hot"].std(ddof=1))


def test_a_rank_outside_its_bracket_is_found(shapes, monkeypatch):
    """Brackets of a wrong place: every group is then ranked whole."""
    df, _ = shapes
    wrong = lambda v, at, accuracy: F.array(*[F.min(v)] * len(at))
    monkeypatch.setattr("rareflow.operators.ordering.F.percentile_approx", wrong)
    probs = {"a": 0.3, "b": 0.77}
    got = moments_and_quantiles(df, ["g"], "v", probs).select("g", *probs).collect()
    assert sized(got) == sized(exact_quantiles(df, ["g"], "v", probs).collect())


def test_only_bracketed_values_are_ranked(spark):
    """Far fewer values than there are: what is written does not grow with the table's width."""
    df = spark.range(200_000).select(F.lit("x").alias("g"), F.rand(3).alias("v"))
    from rareflow.operators import ordering
    sizes, plain = {}, ordering.materialize

    def watched(table, label, *rest):
        out = plain(table, label, *rest)
        sizes[label] = out.count()
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordering, "materialize", watched)
        moments_and_quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5, "t": 0.75}).collect()
    assert sizes["moments"] == 1 and sizes["value-cells"] < 0.02 * 200_000
    assert counted_values(df, ["g"], "v").count() > 190_000
