"""Repeated passages by sparse suffix arrays.

Suffixes are retained at minimiser positions only: in every run of ``window`` word k-grams
the one with the smallest hash. A passage of ``length`` words or more that occurs twice
holds such a position among its first ``window`` words in both places, followed by at least ``stem`` more
words of the passage. Retained suffixes are sorted by the hash of these words, across all
partitions, and neighbours compared: those that agree with neither are done. Of the others all starts
up to ``window - 1`` words to the left are sorted by their next ``length`` words and compared with
their neighbours in the same way, which extends the matches left and right word by word.
The union of what agrees covers exactly the words of all repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rareflow.llm.common import Shelf, small_batches
from rareflow.llm.shingles import WordHashes, windows

SUFFIX = "key long, id long, tag int, pos int"
RUN_ROWS = 100_000           # rows of a key at a partition's edge that wait in memory


PLACE = np.uint64((1 << 24) - 1)   # of a packed hash, its position


def minimisers(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the leftmost smallest k-gram hash of each run of ``window`` k-grams.

    Hash and position are packed into one number; minima of doubling spans give those of
    any window.
    """
    low = windows(words, gram)
    count = len(low) - window + 1
    if count <= 0:
        return np.empty(0, np.int64)
    place = np.arange(len(low), dtype=np.uint64)
    low = (low & ~PLACE) | (place & PLACE)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:count], low[window - span:window - span + count])
    start = np.arange(count, dtype=np.uint64)
    at = start + (((low & PLACE) - (start & PLACE)) & PLACE)
    return np.unique(at[np.append(True, at[1:] != at[:-1])]).astype(np.int64)


@dataclass(frozen=True)
class RepeatedPassages:
    """Passages of ``length`` words or more that occur more than once.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Null and short texts hold
    none, nor do rows without an id; very long texts are taken whole. Rows with the same id and text
    count once; rows with equal ids and different texts are searched as texts of
    their own under one id. Repeats within one text count. Extra columns are ignored.
    An empty table gives an empty result.
    """

    length: int = 50
    gram: int = 8                # words of a k-gram
    window: int = 17

    @property
    def stem(self) -> int:
        return self.length - self.window + 1

    def spans(self, docs: DataFrame, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
        """(doc_id, start_word, end_word, copy_of): a row per repeated span, ends exclusive.

        ``copy_of`` is the smallest id that holds one of the span's passages.
        """
        spark = docs.sparkSession
        shelf = Shelf(spark)
        small_batches(spark)
        # a short tag tells texts under one id apart
        texts = (docs.select(F.col(id_column).cast("long").alias("id"),
                             F.col(text_column).alias("text"))
                 .where("id is not null and text is not null")
                 .withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(65536)).cast("int"))
                 .select("id", "tag", "text"))
        retained = shelf.keep(texts.mapInArrow(self._retain(), SUFFIX), "suffixes")
        sharing = self._repeated(shelf, retained)
        at = shelf.keep(sharing.groupBy("id", "tag").agg(
            F.sort_array(F.collect_set("pos")).alias("at")), "sharing")
        grown = shelf.keep(texts.join(at, ["id", "tag"]).mapInArrow(self._extend(), SUFFIX), "grown")
        matched = self._repeated(shelf, grown)
        starts = matched.groupBy("id", "tag").agg(
            F.collect_list(F.struct("pos", "least")).alias("found"))
        return shelf.finish(starts.select("id", "found").mapInArrow(
            _joined(self.length), "doc_id long, start_word int, end_word int, copy_of long"),
            "passages")

    def _retain(self):
        gram, window, stem = self.gram, self.window, self.stem

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            with np.errstate(over="ignore"):
                for batch in batches:
                    out = []
                    for own, mark, text in zip(*batch.columns, strict=True):
                        words = hashes.of(text.as_py())
                        at = minimisers(words, gram, window)
                        at = at[at <= len(words) - stem]
                        out.append((windows(words, stem)[at], own.as_py(), mark.as_py(), at))
                    yield keyed(out)

        return run

    def _extend(self):
        window, length = self.window, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            with np.errstate(over="ignore"):
                for batch in batches:
                    out = []
                    for own, mark, text, at in zip(*batch.columns, strict=True):
                        whole = windows(hashes.of(text.as_py()), length)
                        starts = (np.array(at.as_py(), np.int64)[:, None]
                                  - np.arange(window)).reshape(-1)
                        starts = np.unique(starts[(starts >= 0) & (starts < len(whole))])
                        out.append((whole[starts], own.as_py(), mark.as_py(), starts))
                    yield keyed(out)

        return run

    def _repeated(self, shelf: Shelf, suffixes: DataFrame) -> DataFrame:
        """Rows whose key a neighbour in the sorted order has; ``least`` is the key's smallest id.

        Partitions are ranges of (key, id, pos), so a frequent key may span several; the
        first and last run of each are settled together.
        """
        order = ["key", "id", "tag", "pos"]
        compared = shelf.keep(
            suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
                _neighbours, f"{SUFFIX}, least long, edge boolean"), "compared")
        # a key at a partition's edge goes on in the next one, or is alone; there are at
        # most two such keys per partition
        edges = {r["key"]: r["smallest"] for r in compared.where("edge").groupBy("key").agg(
            F.count("*").alias("n"), F.min("least").alias("smallest")).where("n > 1").collect()}
        return compared.mapInArrow(_settled(edges), f"{SUFFIX}, least long")


def keyed(found: list[tuple]) -> pa.RecordBatch:
    sizes = [len(at) for *_, at in found]
    column = lambda k: np.repeat(np.array([f[k] for f in found], np.int64), sizes)
    keys = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
    at = np.concatenate([f[3] for f in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(column(1)),
         pa.array(column(2).astype(np.int32)), pa.array(at.astype(np.int32))],
        names=["key", "id", "tag", "pos"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted partition. The first run and the last one are edges."""
    held: list[list[np.ndarray]] = []    # pieces of the open run
    first_key, waiting = None, 0

    def told(pieces: list[list[np.ndarray]], edge_keys: set) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*pieces, strict=True)]
        again = np.zeros(len(columns[0]), bool)              # a repeated row counts once
        again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
        columns = [c[~again] for c in columns]
        key, own = columns[0], columns[1]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        edge = np.isin(key, list(edge_keys))
        repeated = np.repeat(sizes > 1, sizes)
        keep = repeated | edge
        least = np.repeat(own[starts], sizes)                # ids rise within a key
        return pa.RecordBatch.from_arrays(
            [pa.array(c[keep]) for c in (key, own, columns[2].astype(np.int32),
                                         columns[3].astype(np.int32), least, edge)],
            names=["key", "id", "tag", "pos", "least", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        if first_key is None:
            first_key = int(now[0][0])
        last_key = int(now[0][-1])
        cut = int(np.searchsorted(now[0], last_key))
        if cut or held and int(held[0][0][0]) != last_key:
            yield told([*held, [c[:cut] for c in now]], {first_key})
            held, waiting = [], 0
        held.append([c[cut:] for c in now])
        waiting += len(now[0]) - cut
        if last_key == first_key and waiting > RUN_ROWS:     # edges need not wait
            last_row = [c[-1:] for c in held[-1]]
            held[-1] = [c[:-1] for c in held[-1]]
            yield told(held, {first_key})
            held, waiting = [last_row], 1
    if held:
        yield told(held, {first_key, int(held[0][0][0])})


def _settled(edges: dict[int, int]):
    """Rows of a partition's first and last key: kept, with the smallest id, if the key is shared."""
    keys = np.array(sorted(edges), np.int64)
    smallest = np.array([edges[k] for k in keys.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, least = (batch.column(i).to_numpy() for i in (0, 4))
            edge = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            shared = np.zeros(len(key), bool)
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                shared = edge & (keys[slot] == key)
                least = np.where(shared, smallest[slot], least)
            keep = pa.array(~edge | shared)
            columns = [*batch.columns[:4], pa.array(least)]
            yield pa.RecordBatch.from_arrays(
                [c.filter(keep) for c in columns], names=["key", "id", "tag", "pos", "least"])

    return run


def _joined(length: int):
    """Matched starts of a text as spans of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            found = batch.column(1).flatten()
            pos, least = (c.to_numpy() for c in found.flatten())
            text = np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((pos, text))
            pos, least, text = pos[order].astype(np.int64), least[order], text[order]
            opens = np.ones(len(pos), bool)
            opens[1:] = (text[1:] != text[:-1]) | (pos[1:] > pos[:-1] + length)
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(pos)) - 1
            smallest = np.minimum.reduceat(least, first) if len(first) else least
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[text[first]]), pa.array(pos[first].astype(np.int32)),
                 pa.array((pos[last] + length).astype(np.int32)), pa.array(smallest)],
                names=["doc_id", "start_word", "end_word", "copy_of"])
    return run
