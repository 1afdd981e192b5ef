"""Periodic runs against plain loops over all periods."""

import random

import numpy as np
import pytest

from rareflow.llm import runs
from rareflow.llm.queries import looped
from rareflow.llm.runs import PeriodicRuns

SCHEMA = "doc_id long, text string, runs int, strongest string, collapsed string"


def by_loops(words, shortest, copies):
    """Every stretch that agrees with itself ``period`` words later, smallest period first."""
    found, n = {}, len(words)
    for period in range(1, n):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(shortest, copies * period) and j > i:
                found.setdefault((i, j - i + period), period)
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, 120), rng.choice([1, 2, 3, 12])
        words = [f"w{rng.randrange(letters)}" for _ in range(n)]
        if n and rng.random() < 0.5:
            p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        yield words


def search(spark, rows, **settings):
    rows = [(i, t, 1, "x", "y") for i, t in rows]
    return PeriodicRuns(**settings).find(spark.createDataFrame(rows, SCHEMA)).collect()


@pytest.mark.parametrize("shortest,copies", [(24, 3), (6, 2), (1, 2), (7, 4)])
def test_equals_loops(spark, shortest, copies):
    texts = list(random_texts(shortest, 150))
    got = search(spark, [(i, " ".join(w)) for i, w in enumerate(texts)],
                 shortest=shortest, copies=copies)
    assert len(got) == len(texts)
    for row in got:
        words = texts[row["doc_id"]]
        want = by_loops(words, shortest, copies)
        assert [tuple(r) for r in row["runs"]] == want
        assert row["collapsed"] == collapsed(words, want)
        if want:
            best = max(length / period for _, length, period in want)
            assert tuple(row["strongest"]) == min(
                (r for r in want if r[1] / r[2] == best), key=lambda r: (r[0], r[2]))
        else:
            assert row["strongest"] is None


def test_chunks_and_parts_change_nothing(spark, monkeypatch):
    texts = list(random_texts(9, 60))
    searched = lambda: PeriodicRuns(8, 2)._searched(
        [(i, [w.encode() for w in t]) for i, t in enumerate(texts)]).to_pylist()
    whole = searched()
    monkeypatch.setattr(runs, "TESTED_ROWS", 5)
    assert searched() == whole
    alone = [PeriodicRuns(8, 2)._searched([(i, [w.encode() for w in t])]).to_pylist()[0]
             for i, t in enumerate(texts)]
    assert alone == whole


def test_odd_rows(spark):
    run = " ".join(["a b c"] * 8)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, run), (4, run), (None, run), (5, "A " + run),
            (6, run.replace("a", "A", 1)), (7, " \t".join(["x"] * 23)), (8, "x\n" * 24)]
    got = {}
    for r in search(spark, rows):
        got.setdefault(r["doc_id"], []).append((([tuple(x) for x in r["runs"]]), r["collapsed"]))
    assert got[1] == got[2] == got[3] == [([], "")]
    assert got[4] == [([(0, 24, 3)], "a b c")] * 2 and got[None] == got[4][:1]
    assert got[5] == [([(1, 24, 3)], "A a b c")]
    assert got[6] == [([], run.replace("a", "A", 1))]        # 23 words are left of period 3
    assert got[7] == [([], " ".join(["x"] * 23))] and got[8] == [([(0, 24, 1)], "x")]


def test_empty_table(spark):
    assert search(spark, []) == []


def test_long_texts(spark):
    period = [f"p{i}" for i in range(40_000)]
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    rows = [(1, " ".join(["start"] + period * 5)), (2, " ".join(fib[-1])), (3, "x " * 300_000)]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in search(spark, rows)}
    assert got[1] == [(1, 200_000, 40_000)] and got[3] == [(0, 300_000, 1)]
    words = np.array(fib[-1])
    assert len(got[2]) > 100
    for start, length, period in got[2]:
        inside = words[start:start + length]
        assert (inside[period:] == inside[:-period]).all() and length >= max(24, 3 * period)
        assert start == 0 or words[start - 1] != words[start + period - 1]
        end = start + length
        assert end == len(words) or words[end] != words[end - period]


def test_loops_of_the_query():
    words = [b"%d" % i for i in range(50)]
    changed = [i for i in range(200) if looped(i, words) != words]
    assert changed and all(looped(i, []) == [] for i in changed)
    assert looped(None, words) == words
