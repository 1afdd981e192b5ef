"""Rebalancing sizes and reproducibility."""

import pytest
from pyspark.sql import functions as F

from rareflow.operators import sample


def sizes(df, target="target"):
    return {r[target]: r["count"] for r in df.groupBy(target).count().collect()}


def test_published_rebalance_example():
    assert sample.rebalanced_positives(299_764, 11) == 37_049


def test_rebalance(numbered):
    assert sizes(sample.rebalance(numbered, "target", "row_key", 11)) == {
        0: 1714, 1: round(11 * 1714 / 89)}
    with pytest.raises(ValueError):
        sample.rebalance(numbered, "target", "row_key", 50)


def test_sampling_ignores_partitioning(numbered):
    a = sample.rebalance(numbered, "target", "row_key", 11)
    b = sample.rebalance(numbered.repartition(9), "target", "row_key", 11)
    assert a.exceptAll(b).count() == 0


def test_exact_sizes(numbered):
    assert sample.sample_n(numbered, "row_key", 333).count() == 333
    assert sizes(sample.sample_balanced(numbered, "target", "row_key", 200)) == {0: 100, 1: 100}
    assert sizes(sample.sample_shares(numbered, "target", "row_key", 400, {0: 3, 1: 1})) == {
        0: 300, 1: 100}
    assert sizes(sample.undersample(numbered, "target", "row_key")) == {0: 286, 1: 286}
    assert sizes(sample.cap_classes(numbered, "target", "row_key", 50, 70)) == {0: 70, 1: 50}


def test_oversample(numbered):
    assert sizes(sample.oversample(numbered, "target", 10)) == {0: 1714, 1: 2860}
    with pytest.raises(ValueError):
        sample.oversample(numbered, "target", 0)


def test_stratified_split(numbered):
    train, test = sample.stratified_split(numbered, "target", "row_key")
    assert sizes(train) == {0: int(0.8 * 1714), 1: int(0.8 * 286)}
    assert train.select("row_key").intersect(test.select("row_key")).count() == 0
    assert train.count() + test.count() == 2000


def test_shard_draws_repeat_rows(numbered):
    draws = sample.drawn_shards(20, 6, True, "thin:draw")
    out = sample.thin_positive_shards(numbered, "target", "row_key", 20, 0.3, 2)
    per = 286 // 20
    assert sizes(out) == {0: 1714, 1: per * len(draws) * 2}
    assert len(set(sample.drawn_shards(20, 20, False))) == 20


def test_undersampled_shards(numbered):
    out = sample.undersample_shards(numbered, "target", "row_key", 10, 2)
    assert sizes(out) == {0: 2 * 171, 1: 286}


def test_batches_mix_classes(numbered):
    out = sample.mixed_batches(numbered, "target", "row_key", 8)
    rows = out.groupBy("batch").agg(F.count("*").alias("n"), F.sum("target").alias("pos")).collect()
    assert len(rows) == 8
    assert max(r["pos"] for r in rows) - min(r["pos"] for r in rows) <= 1
    assert max(r["n"] for r in rows) - min(r["n"] for r in rows) <= 2


def test_batch_ids(numbered):
    got = sample.batch_ids(numbered, "row_key", 128).groupBy("batch").count().collect()
    assert len(got) == 16
    assert sorted(r["count"] for r in got) == [2000 - 15 * 128] + [128] * 15


def test_shuffle_keeps_all_rows_and_orders_by_hash(numbered):
    out = sample.shuffle_rows(numbered, "row_key", partitions=3)
    assert out.exceptAll(numbered).count() == 0 and out.count() == 2000
    assert out.first()["row_key"] != "k0"


def test_shuffle_of_copies(spark, numbered):
    import rareflow.operators.ordering as ordering
    copies = numbered.withColumn("row_key", F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                 .otherwise(F.col("row_key"))).select("row_key", "target")
    defaults = ordering.HashOrder.__init__.__defaults__
    try:
        ordering.HashOrder.__init__.__defaults__ = (None, 50, None)
        out = sample.shuffle_rows(copies, "row_key")
        assert out.exceptAll(copies).count() == 0 and copies.exceptAll(out).count() == 0
    finally:
        ordering.HashOrder.__init__.__defaults__ = defaults


def test_shards_and_batches_shuffle_no_rows(numbered):
    from rareflow.sources.files import with_shard
    for out in (with_shard(numbered, "row_key", 10, by="target"),
                sample.mixed_batches(numbered, "target", "row_key", 8)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
        assert out.count() == 2000


def test_shards_of_tied_rows_equal_positions(spark, numbered):
    from rareflow.sources.files import with_shard
    tied = numbered.withColumn("row_key", (F.col("id") % 7).cast("string"))
    got = with_shard(tied, "row_key", 9)
    want = with_shard(tied, "row_key", 9, position="at")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 2000


def test_ordered_shards_cut_the_table_as_it_lies(spark, numbered):
    from rareflow.sources.files import with_ordered_shard
    few = numbered.withColumn("half", F.floor(F.col("id") / 2)).repartition(5)
    rows = with_ordered_shard(few, ["half"], 7).collect()
    assert all(r["shard"] == min(r["id"] // (2000 // 7), 7) for r in rows) and len(rows) == 2000
    lone = with_ordered_shard(few.where("id < 3"), ["id"], 7).collect()
    assert [r["shard"] for r in lone] == [7, 7, 7]
