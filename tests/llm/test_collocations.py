"""Frequent phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rareflow.llm import collocations
from rareflow.llm.collocations import BitFilter, Collocations, Summary, chunks, exact_score, tokens

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, n int, words string, key int"
FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_counting(rows, threshold, longest=5, percent=100, top=2000):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLDED)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i:i + k]))
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: f for k, f in counts.items() if f >= threshold}
    out = {}
    for (lang, words), a in frequent.items():
        k = len(words)
        if k == 1 or any(lang == other and len(longer) > k and 100 * f >= percent * a
                         and any(longer[i:i + k] == words for i in range(len(longer) - k + 1))
                         for (other, longer), f in frequent.items()):
            continue
        n = sizes[lang]
        cuts = [(1000 * a * n // (frequent[lang, words[:c]] * frequent[lang, words[c:]]), c)
                for c in range(1, k)]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), frequent[lang, words[:c]],
                                         frequent[lang, words[c:]], n))
    return {(lang, rank, phrase.decode(), -a, first, rest, n, -score)
            for lang, found in out.items()
            for rank, (score, a, phrase, first, rest, n) in enumerate(sorted(found)[:top], 1)}


def found(spark, rows, **settings):
    rows = [(i, t, lang, 7, "x", 1, "y", 3) for i, (t, lang) in enumerate(rows)]
    got = Collocations(**settings).find(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in got.collect()}


def random_rows(seed, count=150):
    rng = random.Random(seed)
    words = ["The", "the", "new", "york", "île", "a", "of", "x\x0b", "New\tYork", "B.", "so,", "é!"]
    words += [f"w{i}" for i in range(30)]
    weights = [9] * 12 + [1] * 30
    return [(" ".join(rng.choices(words, weights, k=rng.randint(0, 60))),
             rng.choice(["en", "en", "de", None, ""])) for _ in range(count)]


@pytest.mark.parametrize("settings", [{}, {"longest": 3, "top": 4}, {"percent": 60, "longest": 4}])
def test_equals_plain_counting(spark, settings):
    rows = random_rows(len(settings))
    want = by_counting(rows, 12, **settings)
    assert found(spark, rows, threshold=12, **settings) == want and len(want) > 10


def test_small_buffers_partitions_and_chunks(spark, monkeypatch):
    rows = random_rows(5)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 10)
    assert found(spark, rows, threshold=15, buffer=300, partition=500) == by_counting(rows, 15)


def test_odd_rows(spark):
    many = "of the " * 50_000
    rows = [(None, "en"), ("", "en"), (" \t\n.", None), (many, "en"), ("of the. of the", "en"),
            ("a b " * 20, None), ("a b " * 20, None), ("a b c", "und")]
    assert found(spark, rows, threshold=20) == by_counting(rows, 20)


def test_empty_table_and_nothing_frequent(spark):
    assert found(spark, []) == set()
    assert found(spark, [("one two three", "en")]) == set()


def test_copies_of_one_phrase_cover_their_parts(spark):
    got = found(spark, [("all of these five words", "en")] * 200 + [("five words", "en")] * 50)
    assert {r[2]: r[3] for r in got} == {"all of these five words": 200, "five words": 250}


@pytest.mark.parametrize("seed", range(5))
def test_no_frequent_key_leaves_a_summary(seed):
    """Merged summaries keep every key that reaches the threshold, within the capacity."""
    rng = np.random.default_rng(seed)
    stream = np.concatenate([rng.zipf(1.3, 60_000) % 50_000, np.full(30_000, 7)]).astype(np.uint64)
    rng.shuffle(stream)
    true = Counter(stream.tolist())
    summary = Summary(40)
    summary.mass = len(stream)
    for piece in np.array_split(stream, 37):
        summary.add(*np.unique(piece, return_counts=True))
        summary.merge()
        assert len(summary.keys) <= summary.capacity
    kept = set(summary.possible(40).column(0).to_numpy().view(np.uint64).tolist())
    assert summary.taken < 40 and summary.taken > 0
    assert {k for k, n in true.items() if n >= 40} <= kept
    assert all(true[k] <= c + summary.taken for k, c in zip(
        summary.keys.tolist(), summary.counts.tolist(), strict=True))


def test_filter_misses_nothing(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    table = spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long")
    for most in (1 << 27, 1 << 16):
        bits = BitFilter.of(table, most)
        assert 64 * len(bits.words) <= max(most, 1 << 16)
        held = set(bits.holding(keys.view(np.uint64)).tolist())
        assert set(range(10_000)) <= held
        assert most == 1 << 16 or len(held) < 10_200


def test_chunks_end_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "CHUNK_BYTES", 20)
    texts = [b"One two, three four. Five six seven eight nine ten eleven", b"x y z", b"A;b c" * 9, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts, pa.binary())],
                                       names=["lang", "text"])
    pieces = lambda text: [p.split() for p in text.split(b".") if p.split()]
    got = [p for _, text in chunks(batch) for p in pieces(text)]
    want = [p for t in texts for p in pieces(t.translate(collocations.FOLD))]
    assert sorted(got) == sorted(want)
    assert tokens(b"a.b c") == [b"a", b".", b"b", b"c"]


def test_score_is_exact_beyond_64_bits(spark):
    big = [(9_000_000_000_123, 10 ** 15 + 7, 9_100_000_000_001, 9_200_000_000_017),
           (100, 10 ** 16, 100, 101)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select(
        "a", exact_score("a", "l", "r", "n").alias("s")).collect()
    assert {r["a"]: r["s"] for r in got} == {a: 1000 * a * n // (l * r) for a, n, l, r in big}
