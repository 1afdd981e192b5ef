"""Streams give the batch result."""

import pytest
from pyspark.sql import functions as F

from rareflow.models.dan import Training, load_checkpoint
from rareflow.models.kernel import Shape
from rareflow.operators import encode, metrics, profile
from rareflow.sources.files import write_csv
from rareflow.streaming import streams


@pytest.fixture()
def shards(spark, numbered, tmp_path):
    df = numbered.withColumn("kind", F.when(F.col("id") % 11 != 0, (F.col("id") % 4).cast("string")))
    path = write_csv(df.repartition(4), str(tmp_path / "shards"))
    return df, streams.read_shards_stream(spark, path, df.schema)


def test_stream_encoding(shards):
    df, stream = shards
    vocabulary = profile.build_vocabulary(df.filter("kind <> '3'"), ["kind"])
    stats = encode.stats_map(profile.numeric_stats(df, ["x"]))
    sizes = encode.dictionary_sizes(vocabulary)
    batch = streams.encode_stream(df, vocabulary, stats, ["kind"], ["x"], sizes)
    streamed = streams.write_stream(
        streams.encode_stream(stream, vocabulary, stats, ["kind"], ["x"], sizes), "test-encode")
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == 2000


def test_stream_metrics(shards):
    df, stream = shards
    scored = lambda d: d.select(F.col("target").alias("y"), (F.col("x") / 11).alias("score"))
    row = streams.stream_metrics(scored(stream)).first()
    assert row["auroc_micro"] == pytest.approx(metrics.auroc_micro(scored(df)).first()[0])
    assert row["accuracy"] == pytest.approx(metrics.accuracy(scored(df)).first()[0])
    assert row["cells"] == 4000


def test_stream_shuffle_keeps_rows(shards):
    df, stream = shards
    out = streams.shuffle_stream(stream.select("row_key"), "row_key")
    assert out.select("row_key").exceptAll(df.select("row_key")).count() == 0
    assert out.select("window").distinct().count() == 4


def test_stream_training_and_scoring(spark, shards, tmp_path):
    df, stream = shards
    rows = stream.select(F.array("x", F.col("id") / 2000).alias("features"),
                         F.col("target").alias("label"))
    path = str(tmp_path / "checkpoints")
    model = streams.fit_stream(rows, Shape(2, (4,), (4,)), Training(), path)
    assert load_checkpoint(spark, f"{path}/weights")[1] == 4
    features = lambda d: d.select("row_key", F.array("x", F.col("id") / 2000).alias("features"))
    scored = streams.predict_stream(features(stream), model, ["row_key"])
    batch = model.transform(features(df)).select("row_key", "score")
    both = scored.join(batch.withColumnRenamed("score", "want"), "row_key")
    assert both.filter(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0
    assert both.count() == 2000


def training_stream(spark, rows, path):
    df = rows.select(F.col("x"), (F.col("id") / 2000).alias("z"), "target")
    source = write_csv(df.repartition(3), str(path))
    return streams.read_shards_stream(spark, source, df.schema).select(
        F.array("x", "z").alias("features"), F.col("target").alias("label"))


def test_stream_training_goes_on(spark, numbered, tmp_path):
    """Epochs, a second stream on the same checkpoint, and a batch that is run twice."""
    path, shape = str(tmp_path / "model"), Shape(2, (), batch_norm=False)
    training = Training(sync="gradient", dtype="float64", learning_rate=0.05)
    first = streams.fit_stream(training_stream(spark, numbered, tmp_path / "a"), shape, training,
                               path, epochs=2)
    one = load_checkpoint(spark, f"{path}/weights")
    assert one.step == 6 and one.state.steps == 6 and (first.flat == one.flat).all()
    assert [step for step, tag, _ in first.log if tag == "cross entropy"] == [3, 6]
    streams.fit_stream(training_stream(spark, numbered, tmp_path / "b"), shape, training, path)
    two = load_checkpoint(spark, f"{path}/weights")
    assert two.step == 9 and (two.flat != one.flat).any()
    batch = numbered.select(F.array("x", F.col("id") / 2000).alias("features"),
                            F.col("target").alias("label"))
    again = streams.train_batch(batch, two.stream_batch, two.stream_pass, shape, training,
                                f"{path}/weights")
    assert again is None and load_checkpoint(spark, f"{path}/weights").step == 9
    assert streams.train_batch(batch, two.stream_batch + 1, two.stream_pass, shape, training,
                               f"{path}/weights") is not None


def test_stream_training_stops_early_and_keeps_the_best(spark, numbered, tmp_path):
    table = numbered.select(F.array("x", F.col("id") / 2000).alias("features"),
                            F.col("target").alias("label"))
    path = str(tmp_path / "model")
    model = streams.fit_stream(
        training_stream(spark, numbered, tmp_path / "a"), Shape(2, (), batch_norm=False),
        Training(sync="gradient", learning_rate=1e-12, early_stopping=1), path,
        validation=table, train=table, epochs=5)
    tags = [tag for _, tag, _ in model.log]
    assert tags.count("validation auroc") == 2 and tags.count("train auroc") == 2
    best = load_checkpoint(spark, f"{path}/best")
    assert (model.flat == best.flat).all() and best.step == 3


def test_a_table_in_many_partitions_is_sharded_as_it_lies(spark, monkeypatch):
    """No sort and no shuffle before the shards are written; every row comes."""
    from rareflow.plans import streams as plans

    written, write = [], plans.write_csv
    monkeypatch.setattr(plans, "write_csv", lambda df, path: written.append(df) or write(df, path))
    rows = spark.range(0, 4000, 1, 24).selectExpr("id", "id % 2 AS y")
    found = streams.write_stream(plans.shard_stream(rows, "many"), "many-out")
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(i, i % 2) for i in range(4000)]
    few = streams.write_stream(plans.shard_stream(rows.coalesce(2), "few"), "few-out")
    assert few.count() == 4000


def test_stream_encode_writes_no_copy_of_its_rows(spark, monkeypatch):
    """Only the vocabulary and the shards are written before the stream runs."""
    from rareflow.plans import streams as plans

    kept, write = [], plans.materialize
    monkeypatch.setattr(plans, "materialize", lambda df, label, *a: kept.append(df.columns) or write(df, label, *a))
    assert plans.stream_encode(spark, "/root/testdata/sf0.001").count() == 6000
    assert kept == [["column", "value", "n", "idx"]]
