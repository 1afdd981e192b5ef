"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from rareflow.llm import minhash
from rareflow.llm.common import Shelf, components
from rareflow.llm.minhash import NearDuplicates

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def all_pairs(rows):
    """doc_id -> (n, component) by comparing every pair."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is None or j is None or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def variants(seed=3, groups=12, members=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((number, " ".join(text) if rng.random() < 0.7 else " ".join(base)))
            number += 1
    rng.shuffle(rows)
    return rows


def found(spark, rows, **settings):
    return NearDuplicates(**settings).groups(spark.createDataFrame(rows, SCHEMA)).collect()


def test_equals_all_pairs(spark):
    rows = variants()
    want = all_pairs(rows)
    got = found(spark, rows, block=8)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one\ttwo"), (None, "one two"),
            (6, long), (7, long + " end"), (8, long), (8, long), (9, "one two three")]
    got = found(spark, rows)
    assert len(got) == len(rows)
    where = {r["doc_id"]: r["component_id"] for r in got}
    assert where == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 6, 8: 6, 9: 9}
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[None] and kept[1] and not kept[8]


def test_hub_with_two_texts(spark):
    """Variants that met such a hub in their only bucket are still compared with each other."""
    class OneBucket(NearDuplicates):
        def _sign(self):
            import pyarrow as pa
            run = NearDuplicates._sign(self)

            def sign(batches):
                for batch in run(batches):
                    yield batch.set_column(4, "bands", pa.array(
                        [[1]] * batch.num_rows, pa.list_(pa.int64())))
            return sign

    hub = [f"w{i}" for i in range(100)]
    x = [*hub[:90], *(f"x{i}" for i in range(25))]
    y = [*x[:-4], *(f"y{i}" for i in range(4))]
    other, near = " ".join(f"o{i}" for i in range(50)), [f"p{i}" for i in range(100)]
    rows = [(0, " ".join(x)), (1, " ".join(y)), (3, " ".join(hub)), (2, other), (3, other),
            (6, " ".join(near)), (7, " ".join([*near[:-2], "q", "r"])), (7, other.replace("o", "u"))]
    x, y, hub, *_ = (shingle_set(t) for _, t in rows)
    assert 100 * len(x & y) >= 75 * len(x | y) and 100 * len(x & hub) < 75 * len(x | hub)
    got = OneBucket().groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {
        0: 0, 1: 0, 2: 2, 3: 2, 6: 6, 7: 6}


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")],
                                 "doc_id long, text string, component_id long, key string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, "x")]


def test_signature_estimates_similarity(spark):
    """Packed low bits give the share of equal minima, corrected for chance."""
    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:520] + [f"v{i}" for i in range(80)]))]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    true = len(a & b) / len(a | b)
    near = NearDuplicates()
    docs = spark.createDataFrame(rows, "id long, text string")
    signed = docs.mapInArrow(near._sign(), minhash.SIGNED)
    one, two = (signed.where(f"id = {i}") for i in (1, 2))
    from pyspark.sql import functions as F
    guess = one.alias("x").join(two.alias("y")).select(
        near._agreeing(F.col("x.bits"), F.col("y.bits"))).first()[0]
    assert guess == pytest.approx(true, abs=0.16)


def test_a_large_group_needs_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(i % 3):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    compared = []
    plain = NearDuplicates._compared

    def counting(self, pairs, texts):
        compared.append(pairs.count())
        return plain(self, pairs, texts)

    monkeypatch.setattr(NearDuplicates, "_compared", counting)
    got = found(spark, rows)
    assert {r["component_id"] for r in got} == {0}
    assert sum(compared) < 3 * len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = components(Shelf(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    where = {r["node"]: r["component"] for r in got}
    assert all(where[i] == 1 for i in range(1, 61)) and where[103] == 100


def test_similar_is_exact():
    one = np.arange(100, dtype=np.uint64)
    shared = lambda a, b: int(minhash.has(a, b).sum())
    assert shared(one[:75], one) == 75 and shared(one[:0], one) == 0
    assert minhash.similar(one[:75], one, 75, 75) and not minhash.similar(one[:74], one, 74, 75)
    assert minhash.packed(np.array([True, False, True])) == [5]
