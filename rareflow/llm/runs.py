"""Periodic runs of words by enhanced suffix arrays.

A run is a stretch of words with a smallest period that no neighbouring word extends.
Texts are cut into the stretches that can hold one: a run of ``shortest`` words repeats its
first words one period later, so grams of ``stem`` words that occur twice in a text cover it.
Their suffixes are sorted by doubling, which also leaves the rank of every gram of 1, 2, 4, ...
words: equality of any two passages, and how far they agree, is read from these.

Neighbours in the sorted order that agree on ``depth`` words split an interval in two. A
square of that period ends where its halves stop agreeing if and only if its two suffixes lie on either
side of such a split. The suffixes of the smaller side are tested for a partner
``depth`` words before or after them on the other side, by rank; there is no tree. Each
square found is rotated to the left as far as it agrees, which gives its run, and runs with
the same ends are merged into the one with the smallest period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rareflow.llm.shingles import mixed, windows

RUN = "start long, length long, period long"
CHUNK_WORDS = 500_000        # words searched together; a longer text is searched alone
TESTED_ROWS = 2_000_000      # suffixes tested at once
STRETCH = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


@dataclass(frozen=True)
class PeriodicRuns:
    """Runs of ``shortest`` words or more whose period occurs ``copies`` times or more.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts hold no run and collapse to an empty
    text; very long texts are searched whole. Every row is searched by itself, so
    repeated ids, rows without an id and copies are rows of their own. Of runs with equal
    length / period the first is the strongest, then the one with the smallest period. Extra
    columns are ignored, whatever their names. An empty table gives an empty result.
    """

    shortest: int = 24
    copies: int = 3

    def __post_init__(self):
        if self.copies < 2:
            raise ValueError("a run holds two copies of its period at least")

    @property
    def stem(self) -> int:
        """Words on which the two ends of a period agree in any run."""
        return -(-self.shortest * (self.copies - 1) // self.copies)

    def find(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             rewrite: Rewrite | None = None) -> DataFrame:
        """(doc_id, runs by start and period, strongest run, collapsed text).

        The collapsed text has the first period of each run only, its words joined by one space.
        ``rewrite`` may replace the words of a text before they are searched.
        """
        texts = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                            F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting, held = [], 0
                for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = text.as_py().split()
                    words = rewrite(own, words) if rewrite else words
                    if waiting and held + len(words) > CHUNK_WORDS:
                        yield self._searched(waiting)
                        waiting, held = [], 0
                    waiting.append((own, words))
                    held += len(words)
                if waiting:
                    yield self._searched(waiting)

        return texts.mapInArrow(
            run, f"doc_id long, runs array<struct<{_fields()}>>, strongest struct<{_fields()}>, "
                 "collapsed string")

    def _searched(self, texts: Sequence[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        sizes = np.array([len(words) for _, words in texts])
        first = np.append(0, np.cumsum(sizes + 1))           # each text is followed by an end mark
        codes: defaultdict[bytes, int] = defaultdict()
        codes.default_factory = codes.__len__
        every = np.zeros(first[-1], np.int64)
        for at, (_, words) in zip(first, texts, strict=False):
            every[at:at + len(words)] = np.fromiter(map(codes.__getitem__, words), np.int64,
                                                    len(words))
        ends = first[1:] - 1
        every[ends] = len(codes) + np.arange(len(ends))
        start, length, period = self._runs(every, np.repeat(np.arange(len(texts)), sizes + 1))

        gone = np.zeros(len(every) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + length, -1)
        keep = np.cumsum(gone[:-1]) == 0
        own = np.searchsorted(first, start, "right") - 1
        order = np.lexsort((period, start))
        bounds = np.searchsorted(own[order], np.arange(len(texts) + 1))
        found = [(int(s), int(n), int(p)) for s, n, p in zip(
            start[order] - first[own[order]], length[order], period[order], strict=True)]
        runs = [found[a:b] for a, b in zip(bounds, bounds[1:])]
        rows = [[dict(zip(STRETCH.names, r, strict=True)) for r in each] for each in runs]
        best = [dict(zip(STRETCH.names, min(each, key=_rank), strict=True)) if each else None
                for each in runs]
        collapsed = [b" ".join(compress(words, keep[at:at + len(words)].tolist()) if each else words)
                     for at, (_, words), each in zip(first, texts, runs, strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in texts], pa.int64()), pa.array(rows, pa.list_(STRETCH)),
             pa.array(best, STRETCH), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "runs", "strongest", "collapsed"])

    def _runs(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, period) of all runs; no two texts share an end mark."""
        words, place = self._recurring(words, text)
        if not len(words):
            return (np.empty(0, np.int64),) * 3
        order, ranks = sorted_suffixes(words)
        start, end, period = [], [], []
        for i, depth in squares(order, agreement(ranks, order[:-1], order[1:])):
            left = agreement(ranks, i, i + depth, backwards=True)
            long = left + 2 * depth >= np.maximum(self.shortest, self.copies * depth)
            start.append((i - left)[long])
            end.append((i + 2 * depth)[long])
            period.append(depth[long])
        if not start:
            return (np.empty(0, np.int64),) * 3
        start, end, period = map(np.concatenate, (start, end, period))
        by = np.lexsort((period, end, start))
        start, end, period = start[by], end[by], period[by]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return place[start[new]], (end - start)[new], period[new]

    def _recurring(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches covered by grams that recur in their text, each with an end mark, and the
        places their words come from."""
        with np.errstate(over="ignore"):
            grams = windows(mixed(words.astype(np.uint64)), self.stem)
            grams ^= mixed(text[:len(grams)].astype(np.uint64) + np.uint64(1))
        by = np.argsort(grams)
        same = grams[by[1:]] == grams[by[:-1]]
        again = np.unique(np.concatenate([by[1:][same], by[:-1][same]]))
        edge = np.zeros(len(words) + 1, np.int64)
        edge[again] += 1
        edge[again + self.stem] -= 1
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(covered):
            return covered, covered
        last = np.append(np.flatnonzero(np.diff(covered) > 1), len(covered) - 1)
        out = np.insert(words[covered], last + 1, words.max() + 1 + np.arange(len(last)))
        return out, np.insert(covered, last + 1, -1)


def _fields() -> str:
    return RUN.replace(" ", ": ").replace(",: ", ", ")


def _rank(run: tuple[int, int, int]) -> tuple:
    start, length, period = run
    return -Fraction(length, period), start, period


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for k = 0, 1, ... the rank of the 2^k words at each place."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks, span = [rank.astype(np.int32)], 1
    while True:
        key = rank * (rank.max() + 2)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key)
        seen = key[order]
        steps = np.cumsum(np.append(0, seen[1:] != seen[:-1]))
        rank = np.empty(len(words), np.int64)
        rank[order] = steps
        if steps[-1] == len(words) - 1:
            return order, ranks
        ranks.append(rank.astype(np.int32))
        span *= 2


def agreement(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray,
              backwards: bool = False) -> np.ndarray:
    """Words that agree from ``x`` and ``y`` on, or before them; ``x`` < ``y`` backwards."""
    x, y, total = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in reversed(range(len(ranks))):
        back = 2 ** k if backwards else 0
        same = ranks[k][x - back] == ranks[k][y - back]      # before the first word: wraps, masked
        step = np.where(same & (x >= back), 2 ** k, 0)
        total += step
        x, y = (x - step, y - step) if backwards else (x + step, y + step)
    return total


def splits(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(split, first, end) in the sorted order: ranks first..split-1 agree with split..end-1
    on exactly ``common[split - 1]`` words."""
    depths = common.tolist()
    first, end, open_ = [0] * len(depths), [len(depths) + 1] * len(depths), []
    for k, depth in enumerate(depths):
        while open_ and depths[open_[-1]] > depth:
            end[open_.pop()] = k + 1
        first[k] = open_[-1] + 1 if open_ else 0
        open_.append(k)
    split = np.flatnonzero(common > 0)
    return split + 1, np.array(first, np.int64)[split], np.array(end, np.int64)[split]


def squares(order: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every square that the next word does not go on with."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    split, first, end = splits(common)
    left = split - first <= end - split                      # the smaller side is tested
    low, high = np.where(left, first, split), np.where(left, split, end)
    sizes = high - low
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TESTED_ROWS)) + 1
    for part in np.split(np.arange(len(split)), cuts):
        if not len(part):
            continue
        own = np.repeat(part, sizes[part])
        upto = np.cumsum(sizes[part])
        i = order[low[own] + np.arange(len(own)) - np.repeat(upto - sizes[part], sizes[part])]
        depth = common[split[own] - 1]
        other_low = np.where(left, split, first)[own]
        other_high = np.where(left, end, split)[own]
        for partner in (i + depth, i - depth):
            inside = (partner >= 0) & (partner < len(order))
            at = rank[np.where(inside, partner, 0)]
            hit = inside & (other_low <= at) & (at < other_high)
            yield np.minimum(i, partner)[hit], depth[hit]
