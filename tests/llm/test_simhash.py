"""SimHash near-duplicates against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from rareflow.llm import common
from rareflow.llm.common import Shelf, lookup
from rareflow.llm.simhash import SimHashDuplicates

SCHEMA = "doc_id long, text string, print int, rep string, copies int, component_id double"


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42)
              for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(prints, bits=3):
    """Smallest id reachable, for (id, fingerprint) rows."""
    root = {i: i for i, _ in prints if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = [(i, p) for i, p in prints if i is not None]
    for k, (i, p) in enumerate(rows):
        for j, q in rows[:k]:
            if (p ^ q).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def found(spark, rows, **settings):
    rows = [(i, t, 1, "x", 2, 0.5) for i, t in rows]
    return SimHashDuplicates(**settings).groups(spark.createDataFrame(rows, SCHEMA)).collect()


def variants(seed, groups=25, members=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(text).title()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_equals_all_pairs(spark, bits):
    rows = variants(bits)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = all_pairs(prints, bits)
    got = found(spark, rows, bits=bits)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("block,bits", [(4096, 3), (6, 3), (3, 2), (2, 1)])
def test_crowded_postings(spark, block, bits):
    """Many fingerprints a few bits apart; a small block sends them to the second index."""
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    for _ in range(400):
        p = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    shelf = Shelf(spark)
    links = SimHashDuplicates(bits=bits, block=block).links(shelf, table)
    pairs = links.collect()
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits for a, b in pairs)
    want = all_pairs(list(zip(signed, prints, strict=True)), bits)
    linked = common.components(shelf, links)
    got = {r["node"]: r["component"] for r in linked.collect()}
    assert {p: got.get(p, p) for p in signed} == want


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(5, None), (2, ""), (9, " \t"), (4, "One two"), (6, "one\ttwo"), (None, "one two"),
            (None, None), (7, long), (8, long), (8, long), (3, "b c d"), (1, "b  c\nd"), (1, "zz")]
    got = found(spark, rows)
    assert len(got) == len(rows)
    where = {(r["doc_id"], r["component_id"]) for r in got}
    assert where == {(5, 2), (2, 2), (9, 2), (4, 4), (6, 4), (None, None), (7, 7), (8, 7), (3, 1), (1, 1)}
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[5] == prints[2] == "0" * 16
    assert prints[7] == f"{plain_fingerprint(long):016x}"


def test_ids_with_several_texts_tie_groups(spark):
    got = found(spark, [(1, "a b c d"), (2, "a b c d"), (2, "p q r s"), (3, "p q r s"), (4, "k l")])
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_copies_and_empty_table(spark):
    assert found(spark, []) == []
    got = found(spark, [(i, "same words in every row") for i in range(3000)] + [(5000, "other")])
    assert {r["component_id"] for r in got} == {0, 5000}


def test_lookup_keeps_rows(spark, monkeypatch):
    rows = spark.range(1000).select(F.pmod("id", F.lit(7)).alias("k"), "id")
    table = spark.createDataFrame([(k, 10 * k, 143) for k in range(7)], "k long, v long, n long")
    for hot in (0, 3, 1000):
        monkeypatch.setattr(common, "HOT_KEYS", hot)
        got = lookup(rows, table, "k", "n").collect()
        assert len(got) == 1000 and all(r["v"] == 10 * r["k"] == 10 * (r["id"] % 7) for r in got)
