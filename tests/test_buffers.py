"""A shuffle buffer and fixed batches across micro-batches, against plain loops."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from rareflow.streaming.buffers import (
    PROVIDER, drained, fixed_batches, places, shuffle_buffer, slot_of)
from rareflow.streaming.streams import read_shards_stream


def files(spark, folder, cuts, rows=200):
    """Files of rows n in [a, b), written one after the other."""
    for a, b in zip(cuts, cuts[1:]):
        (spark.range(a, b).select(F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(
            F.lit("k"), F.col("id"))).alias("name"))
         .coalesce(1).write.mode("append").option("header", True).csv(folder))


def stream(spark, folder):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("n", LongType()), StructField("name", StringType())])
    return read_shards_stream(spark, folder, schema)


def lane_of(n, lanes):
    return int(md5(f"lane:{n}".encode()).hexdigest()[:8], 16) % lanes


def plain(numbers, size, lanes, seed="buffer"):
    out = []
    for lane in range(lanes):
        held, place = {}, 0
        for t, n in enumerate((n for n in numbers if lane_of(n, lanes) == lane), 1):
            slot = slot_of(seed, lane, t, size)
            if t > size:
                place += 1
                out.append((lane, place, held[slot]))
            held[slot] = n
        rest = sorted(held, key=lambda s: md5(f"{seed}:end:{lane}:{s}".encode()).hexdigest())
        out += [(lane, place + i, held[s]) for i, s in enumerate(rest, 1)]
    return sorted(out)


@pytest.mark.parametrize("size,lanes", [(1, 1), (20, 1), (500, 1), (15, 3)])
def test_places_equal_a_plain_buffer(spark, tmp_path, size, lanes):
    folder = str(tmp_path / "in")
    files(spark, folder, [0, 3, 90, 91, 200])
    before = spark.conf.get(PROVIDER)
    run = shuffle_buffer(stream(spark, folder), "n", "n", size, lanes)
    got = drained(run).collect()
    assert sorted((r["lane"], r["place"], r["n"]) for r in got) == plain(range(200), size, lanes)
    assert all(r["name"] == (f"k{r['n']}" if r["n"] % 7 else None) for r in got)
    assert spark.conf.get(PROVIDER) == before
    if size == 1:
        assert [r["n"] for r in sorted(got, key=lambda r: r["place"])] == list(range(200))


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    files(spark, folder, [0, 40, 75])
    shuffle_buffer(stream(spark, folder), "n", "n", 20, 2, folder=state)
    files(spark, folder, [75, 76, 160])
    run = shuffle_buffer(stream(spark, folder), "n", "n", 20, 2, folder=state)
    got = sorted((r["lane"], r["place"], r["n"]) for r in drained(run).collect())
    assert got == plain(range(160), 20, 2)
    assert run.held().count() == 40


@pytest.mark.parametrize("cuts", [[0, 100], [0, 7, 9, 60, 100], [0, 3, 4, 5, 6, 100]])
def test_batches_are_of_one_size(spark, tmp_path, cuts):
    folder = str(tmp_path / "in")
    files(spark, folder, cuts)
    run = fixed_batches(stream(spark, folder), "n", "n", 16)
    sent = sorted((r["place"], r["n"]) for r in run.sent().collect())
    assert sent == [(n + 1, n) for n in range(96)]
    assert sorted((r["slot"], r["n"]) for r in run.held().collect()) == [
        (i, 96 + i) for i in range(4)]


def test_a_lane_is_cut_into_slices(spark, tmp_path):
    """One lane's rows of one micro-batch are numbered by many tasks, equal rows and nulls included."""
    folder = str(tmp_path / "in")
    names = spark.range(4000).select((F.col("id") % 50 + F.when(F.col("id") % 9 > 0, 0)).alias("n"),
                                     F.lit("k").alias("name"))
    names.coalesce(1).write.option("header", True).csv(folder)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = fixed_batches(stream(spark, folder), "name", "n", 128)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert spark.read.parquet(f"{run.folder}/starts").select("slice").distinct().count() > 2
    got = sorted((r["place"], r["n"]) for r in run.sent().collect())
    numbers = sorted((r["n"] for r in names.collect()), key=lambda n: (n is None, n))
    assert got == list(enumerate(numbers[:4000 - 4000 % 128], 1))
    assert run.counts().collect()[0].asDict() == {"lane": 0, "sent": 3968, "held": 32}


def test_a_micro_batch_run_again_replaces_its_rows(spark, tmp_path):
    """Rows of a micro-batch that was stopped before its end are not read, and none come twice."""
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    files(spark, folder, [0, 40])
    run = fixed_batches(stream(spark, folder), "n", "n", 16, folder=state)
    left = spark.read.parquet(f"{state}/rows/batch=0")
    left.write.parquet(f"{state}/rows/batch=1")
    assert run.sent().count() == 32
    files(spark, folder, [40, 70])
    run = fixed_batches(stream(spark, folder), "n", "n", 16, folder=state)
    assert sorted(r["n"] for r in run.sent().collect()) == list(range(64))


@pytest.mark.parametrize("size,width", [(1, 4), (7, 5), (7, 64), (90, 30)])
def test_places_do_not_depend_on_blocks(size, width):
    total, want = 150, {}
    for _, place, n in plain(range(total), size, 1, "s"):
        want[n] = place if place <= total - size else None
    found = [int(p) for first in range(1, total + 1, width)
             for p in places("s", 0, first, width, total, size)]
    assert [p if p > 0 else None for p in found] == [want[n] for n in range(total)]
    held = [n for n in range(total) if want[n] is None]
    assert [-found[n] for n in held] == [slot_of("s", 0, n + 1, size) for n in held]


def test_sizes_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        shuffle_buffer(spark.range(1), "id", "id", 0)
    with pytest.raises(ValueError):
        fixed_batches(spark.range(1), "id", "id", 0)
