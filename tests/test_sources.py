"""Scans, sinks, shards, metadata, generators."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rareflow.operators.clean import normalize_missing
from rareflow.operators.profile import build_vocabulary, cardinality_profile, numeric_stats
from rareflow.sources import files, generators


@pytest.fixture()
def mini_csv(tmp_path):
    path = tmp_path / "mini.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write('id,c,x\n1,,2.5\n2,"",\n3,nan,NaN\n4,-1,1e3\n5,1.0,7\n')
    return str(path)


def test_missing_values_of_a_gzip_csv(spark, mini_csv):
    from pyspark.sql.types import StructType
    df = files.scan_csv(spark, mini_csv, StructType.fromDDL("id int, c string, x double"))
    assert df.rdd.getNumPartitions() > 1
    clean = normalize_missing(df)
    rows = {r["id"]: (r["c"], r["x"]) for r in clean.collect()}
    assert rows == {1: (None, 2.5), 2: (None, None), 3: (None, None), 4: ("-1", 1000.0),
                    5: ("1.0", 7.0)}


def test_defaults(spark):
    df = spark.createDataFrame([(None, None), ("a", 1.5)], "c string, x double")
    assert sorted(map(tuple, files.fill_defaults(df, ["c"], ["x"]).collect())) == [
        ("-1", 0.0), ("a", 1.5)]


def test_schema_checks(spark):
    a = spark.createDataFrame([(1, 2.0)], "c int, x double")
    files.check_schema({"a": a, "b": a}, ["c"], ["x"])
    with pytest.raises(ValueError):
        files.check_schema({"a": a, "b": a.select("x", "c")}, ["c"], ["x"])
    with pytest.raises(ValueError):
        files.check_schema({"a": a}, ["c"], ["x", "y"])


def test_path_class(spark, tmp_path):
    for name in ("train-positive", "train-negative"):
        spark.range(3).write.parquet(str(tmp_path / name))
    df = spark.read.parquet(str(tmp_path / "train-positive"), str(tmp_path / "train-negative"))
    got = {r["path_class"]: r["count"] for r in
           files.with_path_class(df).groupBy("path_class").count().collect()}
    assert got == {"positive": 3, "negative": 3}


@pytest.mark.parametrize("shards,last", [(7, 2000 - 7 * 285), (3000, 2000)])
def test_shards_and_remainder(numbered, shards, last):
    got = {r["shard"]: r["count"] for r in files.with_shard(
        numbered, "row_key", shards).groupBy("shard").count().collect()}
    per = 2000 // shards
    assert got[shards] == last
    assert all(got[s] == per for s in range(shards) if per)


def test_shards_written_and_pruned(spark, numbered, tmp_path):
    sharded = files.with_shard(numbered, "row_key", 10, position="place")
    path = files.write_shards(sharded, str(tmp_path / "shards"), "place", rows_per_file=50)
    chosen = files.read_shards(spark, path, [2, 3], "row_key")
    assert chosen.count() == 400
    assert "PartitionFilters: [shard#" in chosen._jdf.queryExecution().toString()
    shards = [r["shard"] for r in chosen.collect()]
    assert shards == sorted(shards)


def test_shards_are_cut_into_files_without_ranking_rows(spark, numbered, tmp_path):
    """Neither shard nor piece needs a shuffle; shards are those by position, pieces consecutive."""
    found = files.with_shard(numbered, "row_key", 10, piece="piece", rows_per_file=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row_key" not in plan and "row_number()" not in plan
    want = files.with_shard(numbered, "row_key", 10, position="at")
    both = found.join(want.select("row_key", "at", F.col("shard").alias("want")), "row_key").orderBy("at").collect()
    assert len(both) == 2000 and all(r["shard"] == r["want"] for r in both)
    pieces = [r["piece"] for r in both]
    assert pieces == sorted(pieces) and len(set(pieces)) == 40
    assert max(pieces.count(p) for p in set(pieces)) < 60
    path = files.write_shards(found, str(tmp_path / "pieces"), piece="piece")
    assert spark.read.parquet(path).columns == [*numbered.columns, "shard"]
    assert files.read_shards(spark, path, [2, 3], "row_key").count() == 400


def test_a_repeated_key_is_cut_into_several_pieces(spark, monkeypatch):
    from rareflow.operators import ordering

    monkeypatch.setattr(ordering.HashOrder.__init__, "__defaults__", (None, 100, None))
    tied = spark.range(2000).selectExpr("if(id < 1500, 'same', cast(id as string)) AS row_key", "id")
    found = files.with_shard(tied, "row_key", 10, piece="piece", rows_per_file=50)
    sizes = [r["count"] for r in found.groupBy("shard", "piece").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) == 50


def test_union_common_columns(spark):
    a = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    b = spark.createDataFrame([(4, 5)], "c int, a int")
    df = files.union_common([a, b])
    assert df.columns == ["a", "c"]
    assert sorted(map(tuple, df.collect())) == [(1, 3), (5, 4)]


def test_metadata_round_trip(spark, numbered, tmp_path):
    df = numbered.withColumn("c", (F.col("id") % 5).cast("string"))
    path = files.save_metadata(build_vocabulary(df, ["c"]), numeric_stats(df, ["x"]),
                               cardinality_profile(df, ["c"]), str(tmp_path / "meta"))
    vocabulary, stats, cardinality = files.load_metadata(spark, path)
    assert [r["value"] for r in vocabulary.orderBy("idx").collect()] == list("01234")
    assert cardinality.first()["cardinality"] == 5
    text = files.stats_json(stats)
    assert set(json.loads(text)["x"]) == {"mean", "std"}
    again = files.read_metadata_json(spark, json.dumps({"c": ["b", "a"]}), text, '{"4": 201}')
    assert again["cardinality"].first()["position"] == 4
    assert again["vocabulary"].filter("value = 'a'").first()["idx"] == 1


def test_results_are_appended_by_run(spark, tmp_path):
    path = str(tmp_path / "results")
    for run in ("a", "b"):
        files.append_results(spark.createDataFrame([(0.5,)], "auroc double"), path, run)
    assert {r["run_id"] for r in spark.read.parquet(path).collect()} == {"a", "b"}


def test_two_gaussians_shape(spark):
    df = generators.two_gaussians(generators.row_keys(spark, 5000), "row_key", 0.1)
    got = df.groupBy("label").agg(F.count("*").alias("n"), F.avg("x0").alias("m"),
                                  F.stddev("x0").alias("s")).collect()
    rows = {r["label"]: r for r in got}
    assert rows[1]["n"] == 500 and rows[0]["n"] == 4500
    assert abs(rows[1]["m"] - 1) < 0.1 and abs(rows[1]["s"] - 0.4) < 0.05
    assert abs(rows[0]["m"]) < 0.1 and abs(rows[0]["s"] - 1) < 0.05


def test_gaussians_without_positives(spark):
    df = generators.two_gaussians(generators.row_keys(spark, 1000), "row_key", 0.0)
    assert df.filter("label = 1").count() == 0 and df.count() == 1000


def test_mixed_table(spark):
    df = generators.mixed_table(generators.row_keys(spark, 10_000), "row_key", 4,
                                (200, 100, 80, 50))
    assert df.columns == ["row_key", *[f"c{i}" for i in range(4)], *[f"k{i}" for i in range(4)],
                          "label"]
    top = df.agg(*[F.max(f"k{i}") for i in range(4)], F.countDistinct("k0")).first()
    assert tuple(top) == (199, 99, 79, 49, 200)


def test_class_directories_are_pruned(spark, tmp_path):
    path = str(tmp_path / "classes")
    spark.range(10).withColumn("class", F.when(F.col("id") < 3, "positive").otherwise("negative")) \
        .write.partitionBy("class").parquet(path)
    df = files.read_class(spark, path, "positive")
    assert df.count() == 3
    assert "PartitionFilters: [isnotnull(class" in df._jdf.queryExecution().toString()


def test_scratch_is_cleared(spark):
    from rareflow.session import clear_scratch, materialize
    df = materialize(spark.range(3), "clear-me")
    assert df.count() == 3
    name = df.inputFiles()[0]
    clear_scratch(spark)
    import os
    assert not os.path.exists(name.removeprefix("file://"))


def test_splits_are_written_without_a_sort(spark, numbered, tmp_path, monkeypatch):
    """Each split is written as its rows come; all rows come, and no other value is lost."""
    rows = files.with_split(numbered, "row_key")
    written, write = [], type(rows.write).parquet
    monkeypatch.setattr(type(rows.write), "parquet", lambda self, path, **more: (
        written.append(self._df), write(self, path, **more))[1])
    path = files.write_each(rows, "split", ["train", "validation", "test"],
                            lambda df: df.withColumn("twice", F.col("id") * 2), str(tmp_path / "each"))
    assert len(written) == 3
    assert not any("Sort" in df._jdf.queryExecution().executedPlan().toString() for df in written)
    found = spark.read.parquet(path)
    want = rows.withColumn("twice", F.col("id") * 2)
    assert found.select(*want.columns).exceptAll(want).isEmpty() and found.count() == 2000
    with pytest.raises(ValueError):
        files.write_each(rows, "split", ["train", "test"], lambda df: df, str(tmp_path / "two"))
