"""Near-duplicates by SimHash fingerprints and an inverted index of their bytes.

Two fingerprints of eight bytes that differ in ``bits`` bits share 8 - ``bits`` bytes at least, place
by place, and all but one of these lie among the first seven. The index therefore has a
posting for every choice of 7 - ``bits`` of these seven places and the bytes found there. Fingerprints that
meet in a posting get a tally of all the bytes they share; pairs that reach the guaranteed number are
verified bit by bit.

Equal fingerprints are folded first. A posting of more than ``block`` of them is dealt out once more,
by nibbles of the bytes its choice leaves open: of 2 * ``bits`` + 2 nibbles all but ``bits`` must agree, so
the postings of the second index hold 16 ^ ``bits`` fingerprints at most, whatever the table. Of the links within a
posting only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rareflow.llm.common import Shelf, components, lookup
from rareflow.llm.shingles import mixed

BYTES, LOW = 8, np.uint64(63)        # the lowest bits of a key number the choice of places
VOTE_ROWS = 65_536                   # shingle hashes whose bits are counted at once


@dataclass(frozen=True)
class SimHashDuplicates:
    """Documents whose fingerprints differ in ``bits`` bits or fewer are linked.

    A fingerprint bit is set if it is set in over half the XXH64 (``seed``) of a text's shingles of ``words``
    words, repeats included. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with
    fewer words is one shingle. Null and empty texts have fingerprint zero and are linked
    like any other. Very long texts are hashed whole, their bits counted in pieces. Rows without
    an id have a fingerprint and are linked with nothing. An id with several texts ties
    their groups together, and repeated rows are repeated in the result. Extra columns are
    ignored, whatever their names. An empty table gives an empty result.
    """

    words: int = 3
    bits: int = 3
    seed: int = 42
    block: int = 4096

    def __post_init__(self):
        if not 1 <= self.bits <= 3:
            raise ValueError("bits must be 1, 2 or 3")

    def fingerprint(self, text: bytes) -> int:
        words = text.lower().split()
        if not words:
            return 0
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        size = min(self.words, len(words))
        starts = np.append(0, ends)[:len(words) - size + 1]
        shingles = map(flat.__getitem__, map(slice, starts.tolist(), (ends[size - 1:] - 1).tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(self.seed)),
                             np.uint64, len(starts))
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), VOTE_ROWS):
            part = hashes[at:at + VOTE_ROWS].view(np.uint8)
            votes += np.add.reduce(np.unpackbits(part, bitorder="little").reshape(-1, 64),
                                   axis=0, dtype=np.uint32)
        return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])

    def fingerprints(self, docs: DataFrame, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
        """(id, print): the fingerprint as a signed 64-bit number, a row per row of ``docs``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [self.fingerprint(text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                    names=["id", "print"])

        return docs.select(
            F.col(id_column).cast("long").alias("id"),
            F.coalesce(text_column, F.lit("")).cast("binary").alias("text"),
        ).mapInArrow(run, "id long, print long")

    def groups(self, docs: DataFrame, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
        """(doc_id, fingerprint, component_id), a row per row of ``docs``."""
        shelf = Shelf(docs.sparkSession)
        prints = shelf.keep(self.fingerprints(docs, id_column, text_column), "prints")
        known = prints.where("id is not null")
        folded = shelf.keep(known.groupBy("print").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies")), "folded")

        rep = lambda side: folded.select(F.col("print").alias(side), F.col("rep").alias(
            f"rep_{side}"))
        near = self.links(shelf, folded.select("print"))
        links = near.join(rep("a"), "a").join(rep("b"), "b").select(
            F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        several = known.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high"))
        several = shelf.keep(several.where("low < high").select("id"), "several")
        tied = known.join(several, "id").distinct().join(folded, "print").select(
            F.col("id").alias("a"), F.col("rep").alias("b"))
        whole = components(shelf, links.unionByName(tied))

        placed = folded.join(whole, F.col("rep") == F.col("node"), "left").select(
            "print", "copies", F.coalesce("component", "rep").alias("component_id"))
        found = lookup(known, shelf.keep(placed, "placed"), "print", "copies").unionByName(
            prints.where("id is null").withColumn("component_id", F.lit(None).cast("long")))
        digits = F.lpad(F.lower(F.hex("print")), 16, "0")
        return shelf.finish(found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"),
                                         "component_id"), "groups")

    def links(self, shelf: Shelf, prints: DataFrame) -> DataFrame:
        """(a, b) of distinct fingerprints: all their links, up to those implied by others."""
        found = shelf.keep(self._postings(prints.mapInArrow(self._first_keys(), POSTING)), "postings")
        links = self._compared(found.where(F.col("n") <= self.block))
        again = found.where(F.col("n") > self.block).select("key", "print")
        again = shelf.keep(self._postings(again.mapInArrow(self._second_keys(), POSTING)), "again")
        return shelf.keep(links.unionByName(self._compared(again)), "links")

    def _postings(self, index: DataFrame) -> DataFrame:
        """(key, print, n) where the posting of ``key`` holds n > 1 fingerprints."""
        sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return index.join(sizes.hint("merge"), "key")

    def _places(self) -> list[tuple[int, ...]]:
        return list(combinations(range(BYTES - 1), BYTES - 1 - self.bits))

    def _first_keys(self):
        masks = [sum(255 << 8 * p for p in chosen) for chosen in self._places()]
        return _keyed(np.array([masks], np.uint64), first=True)

    def _second_keys(self):
        rows = []
        for chosen in self._places():
            nibbles = [2 * p + half for p in range(BYTES) if p not in chosen for half in (0, 1)]
            rows.append([sum(15 << 4 * q for q in agreeing)
                         for agreeing in combinations(nibbles, len(nibbles) - self.bits)])
        return _keyed(np.array(rows, np.uint64), first=False)

    def _compared(self, postings: DataFrame) -> DataFrame:
        """Links of each posting; a task holds a few postings at a time."""
        shared, bits, block = BYTES - self.bits, self.bits, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, found = np.empty(0, np.int64), np.empty(0, np.uint64)
            for batch in batches:
                key = np.concatenate([key, batch.column(0).to_numpy()])
                found = np.concatenate([found, batch.column(1).to_numpy().view(np.uint64)])
                if len(key) > block:
                    whole = int(np.searchsorted(key, key[-1]))   # the last posting may go on
                    yield linked(key[:whole], found[:whole], shared, bits)
                    key, found = key[whole:], found[whole:]
            yield linked(key, found, shared, bits)

        return (postings.select("key", "print").repartition("key").sortWithinPartitions("key")
                .mapInArrow(run, "a long, b long"))


POSTING = "key long, print long"


def _keyed(masks: np.ndarray, first: bool):
    """A row per fingerprint and mask: the masked bytes, mixed, over the number of the choice.

    The first index applies all masks; the second one those of the choice a posting came from.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            if first:
                mine = masks[0]
                salt = choice = np.arange(len(mine), dtype=np.uint64)
            else:
                old = batch.column(0).to_numpy().view(np.uint64)
                choice = (old & LOW)[:, None]
                mine = masks[choice[:, 0].astype(np.int64)]
                salt = mixed(old)[:, None] + np.arange(masks.shape[1], dtype=np.uint64)
            with np.errstate(over="ignore"):
                keys = mixed(mixed(found[:, None] & mine) + mixed(salt + np.uint64(1)))
            keys = (keys & ~LOW) | choice
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)),
                 pa.array(np.repeat(found.view(np.int64), keys.shape[1]))], names=["key", "print"])

    return run


def linked(key: np.ndarray, found: np.ndarray, shared: int, bits: int) -> pa.RecordBatch:
    """A spanning forest of the links in each posting of the sorted ``key``."""
    root = np.arange(len(key))
    out: list[tuple[int, int]] = []
    rows = np.arange(len(key))
    for ahead in range(1, len(key)):
        rows = rows[:np.searchsorted(rows, len(key) - ahead)]
        rows = rows[key[rows] == key[rows + ahead]]
        if not len(rows):
            break
        differing = found[rows] ^ found[rows + ahead]
        tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        close = rows[tally >= shared]
        close = close[np.bitwise_count(found[close] ^ found[close + ahead]) <= bits]
        while (root[root] != root).any():
            root = root[root]
        apart = close[root[close] != root[close + ahead]]
        for i, j in zip(apart.tolist(), (apart + ahead).tolist(), strict=True):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    at = np.array(out, np.int64).reshape(-1, 2)
    prints = found.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(prints[at[:, 0]]), pa.array(prints[at[:, 1]])],
                                      names=["a", "b"])
