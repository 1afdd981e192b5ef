"""Line dedup by pairwise alignment.

Patience diff finds the lines that two documents have in common in the same order, and blocks of
them are deleted from the later document, the one with the larger id. Exact copies are folded
before and lose what they would lose against the first copy: all their lines.

The quick rule aligns documents that share a line held by few documents with each other, and a
document with a frequent line with the first document that holds it. The whole rule gives what
aligning all pairs gives: a block holds one of the shortest runs of lines with as many characters
as a block needs, so only documents that share such a run are aligned. Those with a run
held by few documents all meet; those with a frequent one meet its first holder, and then ever
more of the earlier holders, until the run is deleted or all have been met.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rareflow.llm.common import Shelf, lookup, shielded, small_batches, star_blocks
from rareflow.llm.shingles import mixed

BASE = 0x9E3779B97F4A7C15    # of the hashes of runs of lines
STEP = 16                    # holders of a run met in a round, and growth of the rounds


@dataclass(frozen=True)
class LineDedup:
    """Deletes blocks of lines that an earlier document has in the same order.

    A block counts if its lines, trimmed, have ``block_chars`` characters or more. Lines are
    compared trimmed, by 64-bit hash; blank lines only extend blocks. Null texts stay null, empty
    texts and rows without an id stay as they are; rows with equal ids and texts are treated
    alike, rows with equal ids but different texts as one document whose smallest text
    counts. Very long texts are aligned whole. Extra columns stay, whatever their names. Every line shared by two documents makes at least one pair: of up to
    ``rare`` documents all pairs, of more each one with the first. With ``whole`` the result is
    that of all pairs of documents, whatever ``rare`` is.
    """

    rare: int = 6
    block_chars: int = 50
    whole: bool = False

    def clean(self, docs: DataFrame, id_column: str = "doc_id",
              text_column: str = "text") -> DataFrame:
        """``docs`` with the shortened text, n_lines and n_removed, which replace columns so named."""
        return shielded(docs, [id_column, text_column],
                        lambda base: self._clean(base, id_column, text_column),
                        ["n_lines", "n_removed"])

    def _clean(self, base: DataFrame, id_column: str, text_column: str) -> DataFrame:
        shelf = Shelf(base.sparkSession)
        lines = F.transform(F.split("text", "\n"), F.trim)
        rows = (base.select(F.col(id_column).cast("long").alias("id"),
                            F.col(text_column).alias("text"))
                .where("id is not null and text is not null and trim(text) <> ''")
                .withColumns({"print": F.md5("text"), "line": lines})
                .select("id", "print", F.transform("line", lambda x: F.when(
                    x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("lines"),
                    F.transform("line", F.length).alias("sizes")))
        rows = shelf.keep(rows, "lines")
        single = rows.groupBy("id").agg(F.min("print").alias("print"))
        firsts = shelf.keep(single.groupBy("print").agg(F.min("id").alias("id")), "firsts")
        texts = shelf.keep(rows.join(firsts, ["id", "print"], "left_semi")
                           .dropDuplicates(["id"]), "texts")
        if self.whole:
            removed = self._wholly(shelf, texts)
        else:
            pairs = shelf.keep(self._pairs(texts), "pairs")
            removed = shelf.keep(merged(self._aligned(pairs, texts)), "removed")
        copies = (single.join(firsts.select("print", F.col("id").alias("first")), "print")
                  .where("id <> first").select("id", F.lit(True).alias("copy")))
        decided = shelf.finish(copies.join(removed, "id", "full"), "decided")

        parts = F.split(text_column, "\n")
        full = F.sequence(F.lit(0), F.size(parts) - 1)
        chars = F.aggregate(F.transform(parts, lambda x: F.length(F.trim(x))), F.lit(0),
                            lambda a, b: a + b)
        gone = F.when(F.col("copy") & (chars >= self.block_chars), full).otherwise(F.coalesce(
            "gone", F.array().cast("array<int>")))
        known = (F.col(id_column).cast("long") == F.col("id")) & F.col(text_column).isNotNull()
        # texts move by shuffle at every size: no side is known to stay small
        out = base.join(decided.hint("merge"), known, "left").withColumn("__gone", gone)
        left = F.array_except(full, F.col("__gone"))
        text = F.when(F.size("__gone") == 0, F.col(text_column)).otherwise(F.array_join(
            F.transform(left, lambda i: F.get(parts, i)), "\n"))
        n_lines = F.when(F.coalesce(F.col(text_column), F.lit("")) == "", 0).otherwise(
            F.size(parts)).cast("long")
        columns = [text.alias(c) if c == text_column else F.col(f"`{c}`") for c in base.columns]
        return out.select(*columns, n_lines.alias("n_lines"), F.when(
            F.col(text_column).isNull(), 0).otherwise(F.least(
                F.size("__gone"), F.size(parts))).cast("long").alias("n_removed"))

    def _pairs(self, texts: DataFrame) -> DataFrame:
        """(a, b): earlier and later documents to be aligned."""
        held = texts.select("id", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
        counted = held.groupBy("line").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        shared = held.join(counted.where("n > 1"), "line")
        first = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        rare = shared.where(F.col("n") <= self.rare).select("line", "id")
        among = (rare.groupBy("line").agg(F.collect_list("id").alias("ids"))   # at most ``rare``
                 .select("ids", F.explode("ids").alias("a"))
                 .select("a", F.explode("ids").alias("b")).where("a < b"))
        return first.unionByName(among).distinct()

    def _wholly(self, shelf: Shelf, texts: DataFrame) -> DataFrame:
        """(id, gone) as from all pairs of documents."""
        held = shelf.keep(self._runs(texts), "runs")
        counted = shelf.keep(held.groupBy("key").agg(
            F.count(F.when(F.col("times") > 0, 1)).alias("n"), F.min("id").alias("first"),
            F.min(F.when(F.col("times") == 1, F.col("id"))).alias("single"),
            F.count("*").alias("uses")).where("n > 1"), "counted")
        # the runs that most documents hold do not meet in one task
        shared = shelf.keep(lookup(held, counted, "key", "uses"), "shared")
        holders = shared.where("times > 0")
        rare = holders.where(F.col("n") <= self.rare).select("key", "id")
        among = (rare.groupBy("key").agg(F.collect_list("id").alias("ids"))   # at most ``rare``
                 .select("ids", F.explode("ids").alias("a"))
                 .select("a", F.explode("ids").alias("b")).where("a < b"))
        frequent = holders.where(F.col("n") > self.rare)
        starts = [frequent.where(f"{hub} < id").select(F.col(hub).alias("a"), F.col("id").alias("b"))
                  for hub in ("first", "single")]
        tried = shelf.keep(among.unionByName(starts[0]).unionByName(starts[1]).distinct(), "pairs")
        removed = shelf.keep(merged(self._aligned(tried, texts)), "removed")

        later = shelf.keep(
            shared.where((F.col("n") > self.rare) & (F.col("first") < F.col("id"))).groupBy("id")
            .agg(F.collect_list(F.struct("key", "low", "high")).alias("runs")), "frequent")
        # a pseudo-random place among the holders, from the id alone
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30) * F.col("n")
        most, low, high = frequent.agg(F.max("n")).first()[0] or 0, 0, STEP
        while low < most:
            left = shelf.keep(self._left(later.join(removed, "id", "left")), "left")
            if left.isEmpty():
                break
            met = frequent.where((place >= low) & (place < high)).select("key", F.col("id").alias("a"))
            pairs = left.join(met, "key").where("a < b").select("a", "b").distinct()
            pairs = shelf.keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                tried = tried.unionByName(pairs)
                removed = shelf.keep(merged(removed.unionByName(self._aligned(pairs, texts))), "removed")
            low, high = high, high * STEP
        return removed

    def _runs(self, texts: DataFrame) -> DataFrame:
        """(id, key, low, high, times): shortest runs of lines with ``block_chars`` characters.

        A run is there per place; ``times`` counts its places at the first of them and is zero at others.
        """
        least = max(1, self.block_chars)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, parts = [], []
                for i, lines, sizes in zip(*batch.columns, strict=True):
                    parts.append(shortest_runs(lines.values.to_numpy(zero_copy_only=False),
                                               sizes.values.to_numpy(zero_copy_only=False), least))
                    own.append(np.full(len(parts[-1][0]), i.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own) if own else np.empty(0, np.int64))]
                    + [pa.array(np.concatenate([p[k] for p in parts]) if own
                                else np.empty(0, np.int64)) for k in range(4)],
                    names=["id", "key", "low", "high", "times"])

        small_batches(texts.sparkSession)
        return texts.select("id", "lines", "sizes").mapInArrow(
            run, "id long, key long, low long, high long, times long")

    def _left(self, later: DataFrame) -> DataFrame:
        """(b, key): frequent runs of which a line is still there."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, keys = [], []
                for i, runs, gone in zip(*batch.columns, strict=True):
                    gone = np.array(gone.as_py() or [], np.int64)
                    key, low, high = (runs.values.field(k).to_numpy() for k in range(3))
                    before = np.searchsorted(gone, low), np.searchsorted(gone, high)
                    key = np.unique(key[before[1] - before[0] < high - low])
                    keys.append(key)
                    own.append(np.full(len(key), i.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (own, keys)],
                    names=["b", "key"])

        return later.select("id", "runs", "gone").mapInArrow(run, "b long, key long")

    def _aligned(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, gone): positions of lines deleted from the later document of each pair."""
        least = self.block_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, hub = None, []
            for batch in batches:
                ids, gone = [], []
                for a, block, b, lines, sizes in zip(*batch.columns, strict=True):
                    a, block, b, lines = a.as_py(), block.as_py(), b.as_py(), lines.as_py()
                    if (a, block) != at:
                        at = (a, block)
                    if b is None:
                        hub = lines
                    elif found := common_blocks(hub, lines, sizes.as_py(), least):
                        ids.append(b)
                        gone.append(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                    names=["id", "gone"])

        return star_blocks(pairs, texts, ["lines", "sizes"]).mapInArrow(
            run, "id long, gone array<int>")


def merged(found: DataFrame) -> DataFrame:
    """The positions of each document, sorted, from any number of rows."""
    return found.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def shortest_runs(lines: np.ndarray, sizes: np.ndarray,
                  least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, low, high, times) of the shortest runs with ``least`` characters.

    One begins at each line and one ends at each line. Every line of a longer block lies
    in one that the block holds: the one from the block's first line, or the one that ends there.
    """
    count = len(lines)
    chars = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(count)
    stop = np.searchsorted(chars, chars[:-1] + least)
    start = np.searchsorted(chars, chars[1:] - least, "right") - 1
    spans = np.unique(np.concatenate([(at * (count + 1) + stop)[stop <= count],
                                      (start * (count + 1) + at + 1)[start >= 0]]))
    low, high = np.divmod(spans, count + 1)
    with np.errstate(over="ignore"):
        power, back = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(count, x, np.uint64)))
                       for x in (BASE, pow(BASE, -1, 1 << 64)))
        terms = mixed(lines.astype(np.int64).view(np.uint64) + np.uint64(BASE)) * power[:-1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        key = mixed((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64))
    key = key.view(np.int64)
    _, first, seen = np.unique(key, return_index=True, return_counts=True)
    times = np.zeros(len(key), np.int64)
    times[first] = seen
    return key, low, high, times


def patience(one: list, two: list) -> list[tuple[int, int]]:
    """Matching positions in rising order: equal ends, then lines unique in both, then between.

    Zero stands for a blank line and never anchors.
    """
    matches, work = [], [(0, len(one), 0, len(two))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and one[a] == two[c]:
            matches.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            matches.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(one[a:b]), Counter(two[c:d])
        place = {two[j]: j for j in range(c, d) if two[j] and right[two[j]] == 1}
        anchors = rising([(i, place[one[i]]) for i in range(a, b)
                          if one[i] in place and left[one[i]] == 1])
        if not anchors:
            continue
        for i, j in [*anchors, (b, d)]:
            work.append((a, i, c, j))
            a, c = i, j                      # the anchor itself is met as an equal start
    return sorted(matches)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides (first sides rise already)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(one: list, two: list, sizes: list[int], least: int) -> list[int]:
    """Positions in ``two`` of aligned blocks with ``least`` characters or more."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*patience(one, two), (-1, -1)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(sizes[j] for _, j in block) >= least:
                out += [j for _, j in block]
            block = []
        block.append(pair)
    return out


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with shortened texts; documents of which nothing is left go. Columns stay."""
    def left(base: DataFrame) -> DataFrame:
        cleaned = LineDedup(**settings).clean(base).where("n_removed = 0 or trim(text) <> ''")
        if "n_chars" in base.columns:
            cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
        return cleaned.select(base.columns)

    return shielded(docs, ["doc_id", "text", "n_chars"], left)
