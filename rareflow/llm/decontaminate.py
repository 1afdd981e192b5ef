"""Benchmark decontamination by q-gram lemma filtering.

A text region within e edits of an item of m characters shares at least m - q + 1 - q e
q-grams with it, all on diagonals that differ by at most e. Shared q-grams are counted in
diagonal bands of width 2 (e + 1) that overlap by half, so each such region lies in one band;
bands that meet the bound are verified by banded alignment.

The index of items is built per chunk of bounded size; each chunk is one pass
over the texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, StructField, StructType)

from rareflow.llm.common import add_columns, shielded
from rareflow.llm.shingles import mixed

HIT = StructType([StructField("item_id", LongType()), StructField("start", IntegerType()),
                  StructField("end", IntegerType()), StructField("edits", IntegerType())])
TABLE_BITS = 22              # of the table that rules out most q-grams at once
PIECE = 200_000              # characters of a text searched at a time
WIDEST = 4_000               # characters of an item aligned as one


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits, A-Z in lower case, other runs as one blank; and their places."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (points >= 65) & (points <= 90)
    word = upper | ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57)) | (points > 127)
    after = np.zeros(len(points), bool)
    after[1:] = word[:-1]
    place = np.flatnonzero(word | after)
    points = np.where(word, points + 32 * upper, 32)[place].astype(np.uint32)
    if len(points) and points[-1] == 32:
        return points[:-1], place[:-1]
    return points, place


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    count = len(points) - q + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    odd = mixed(np.arange(501, 501 + q, dtype=np.uint64)) | np.uint64(1)
    total, wide = np.zeros(count, np.uint64), points.astype(np.uint64)
    for i in range(q):
        total += wide[i:i + count] * odd[i]
    return mixed(total)


class ItemIndex:
    """q-gram postings of the items of one chunk."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.items = q, []
        grams, owners, places = [], [], []
        self.budget, self.bound = [], []
        for item_id, text in items:
            points, _ = normalised(text)
            pieces = max(1, -(-len(points) // WIDEST))
            for part in np.array_split(points, pieces):      # of nearly equal length
                m = len(part)
                if m < q:
                    continue                      # too short to tell from chance
                edits = min(int(m * rate), (m - q) // q)
                found = qgrams(part, q)
                grams.append(found)
                owners.append(np.full(len(found), len(self.items)))
                places.append(np.arange(len(found)))
                self.items.append((item_id, part))
                self.budget.append(edits)
                self.bound.append(m - q + 1 - q * edits)
        grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.owner = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.empty(0, np.int64))[order]
        self.gram, self.first, self.count = np.unique(
            grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.gram >> np.uint64(64 - TABLE_BITS)] = True
        self.budget = np.array(self.budget, np.int64)
        self.bound = np.array(self.bound, np.int64)
        self.reach = int(max((len(p) for _, p in self.items), default=0)
                         + 4 * (self.budget.max(initial=0) + 1))

    def search(self, text: str) -> list[dict]:
        """The best region of each item that is within its budget."""
        points, place = normalised(text)
        best: dict[int, tuple[int, int, int]] = {}
        for start in range(0, max(1, len(points)), PIECE):
            self._search(points, start, min(len(points), start + PIECE + self.reach), best)
        return [{"item_id": i, "start": int(place[s]), "end": int(place[e - 1]) + 1, "edits": d}
                for i, (d, s, e) in sorted(best.items())]

    def _search(self, points: np.ndarray, low: int, high: int, best: dict) -> None:
        found = qgrams(points[low:high], self.q)
        near = np.flatnonzero(self.table[found >> np.uint64(64 - TABLE_BITS)])
        if not len(near) or not len(self.gram):
            return
        slot = np.minimum(np.searchsorted(self.gram, found[near]), len(self.gram) - 1)
        hit = self.gram[slot] == found[near]
        near, slot = near[hit], slot[hit]
        counts = self.count[slot]
        total = int(counts.sum())
        if not total:
            return
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        post = np.repeat(self.first[slot], counts) + within
        owner = self.owner[post]
        shift = len(points) + WIDEST                         # keeps diagonals above zero
        diagonal = np.repeat(near, counts) - self.place[post] + shift
        width = self.budget[owner] + 1
        band = diagonal // width
        # a band covers two widths: its own and the next, so each hit counts in two
        key = np.concatenate([owner, owner]) * (4 * shift + 8) + np.concatenate(
            [band, band - 1]) + 1
        key, seen = np.unique(key, return_counts=True)
        owner, band = np.divmod(key, 4 * shift + 8)
        good = seen >= self.bound[owner]
        done: set[tuple[int, int]] = set()
        for o, b in zip(owner[good].tolist(), (band[good] - 1).tolist(), strict=True):
            item_id, part = self.items[o]
            edits = int(self.budget[o])
            start = b * (edits + 1) - shift + low
            start, stop = start - edits, start + 2 * (edits + 1) + edits
            if (o, start) in done:
                continue
            done.add((o, start))
            result = banded(part, points, start, stop, edits)
            if result and (item_id not in best or (result[0], result[1]) < best[item_id][:2]):
                best[item_id] = result


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int,
           budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region on the diagonals low..high, within the budget.

    Row i holds the costs of aligning the item's first i characters to end at text
    positions low + i .. high + i. Diagonals below zero are met by items whose first
    characters are missing.
    """
    if high < 0:
        return None                      # the item would start before the text does
    width, far = high - low + 1, np.int64(1 << 30)
    offsets = np.arange(width)
    start = low + offsets
    cost = np.where((start >= 0) & (start <= len(text)), 0, far)
    front = max(0, -low)
    blank = lambda n: np.full(max(0, n), 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([blank(front), text, blank(high + len(item) + 1 - len(text))])
    for i, char in enumerate(item):
        here = padded[front + low + i:front + low + i + width]    # the text position consumed
        match = cost + (here != char)
        skip = np.append(cost[1:], far) + 1               # the item's character is missing
        take = match <= skip
        new = np.where(take, match, skip)
        came = np.where(take, start, np.append(start[1:], 0))
        # extra text characters: the cheapest cell to the left plus the way
        base = new - offsets
        run = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == run, offsets, 0))
        cost, start = run + offsets, came[source]
        if int(cost.min()) > budget:
            return None
    ends = low + len(item) + offsets
    cost = np.where((ends > 0) & (ends <= len(text)), cost, far)
    k = int(cost.argmin())
    if int(cost[k]) > budget or int(ends[k]) <= int(start[k]):
        return None
    return int(cost[k]), int(start[k]), int(ends[k])


@dataclass(frozen=True)
class Decontamination:
    """Finds benchmark items in texts, with up to ``rate`` edits per character.

    Case, blanks and punctuation do not count. Null and empty texts and items match nothing, nor
    do items of fewer than ``q`` letters; the edits of an item of m letters are also at most (m - q) / q,
    which the q-gram bound needs. Long texts are searched in overlapping pieces. Items over 4,000 letters
    are cut into equal parts of 2,000 letters or more, and a text that holds a part holds the item. Repeated items give repeated hits under their own ids; rows
    without an item id are left out. Repeated rows get equal results; a column named
    ``hits`` is replaced.
    """

    q: int = 12
    rate: float = 0.05
    chunk_chars: int = 4_000_000     # characters of items per pass over the texts

    def chunks(self, items: DataFrame) -> list[list[tuple[int, str]]]:
        """Items in chunks of bounded size, read one after the other."""
        rows = items.where("item_id is not null and text is not null").orderBy("item_id", "text")
        out, size = [[]], 0
        for row in rows.select("item_id", "text").toLocalIterator():
            if size and size + len(row["text"]) > self.chunk_chars:
                out.append([])
                size = 0
            out[-1].append((int(row["item_id"]), row["text"]))
            size += len(row["text"])
        return out

    def mark(self, docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
        """``docs`` with ``hits``: item_id, start, end (code points, end exclusive), edits."""
        extra = StructType([StructField("hits", ArrayType(HIT))])
        out = docs.drop("hits")
        names = out.columns
        position = names.index(text_column)
        parts = []
        for i, chunk in enumerate(self.chunks(items)):
            q, rate = self.q, self.rate
            holder: dict[str, ItemIndex] = {}

            def work(batch: pa.RecordBatch, chunk=chunk, holder=holder) -> list[pa.Array]:
                with np.errstate(over="ignore"):
                    if "index" not in holder:
                        holder["index"] = ItemIndex(chunk, q, rate)
                    return [pa.array([holder["index"].search(t.as_py())
                                      for t in batch.column(position)],
                                     pa.list_(pa.struct([("item_id", pa.int64()),
                                                         ("start", pa.int32()), ("end", pa.int32()),
                                                         ("edits", pa.int32())])))]

            out = add_columns(out, extra, work).withColumnRenamed("hits", f"__hits{i}")
            parts.append(f"__hits{i}")
        return out.withColumn("hits", F.concat(*parts)).select(*names, "hits")


def without_benchmark(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without documents that hold an item of the benchmark. Columns stay."""
    def clean(base: DataFrame) -> DataFrame:
        marked = Decontamination(**settings).mark(base, items)
        return marked.where(F.size("hits") == 0).select(base.columns)

    return shielded(docs, ["text"], clean)
