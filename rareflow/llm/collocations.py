"""Frequent phrases and how strongly their words belong together.

Words are counted first. Of all pairs of frequent words, tasks build
summaries per hash partition: a buffer of n-grams becomes sorted keys and counts. Longer
n-grams follow in the same way, if all their pairs have survived. A
partition's summaries are merged by the rule of Misra and Gries, with a capacity that exceeds the partition's mass
divided by the threshold: whenever more counters are held, the first count beyond the
capacity is taken off all of them, so an n-gram loses less than the threshold in all, and none that
is frequent goes. What has been taken off is known, so counters that cannot
reach the threshold go at the end. A last pass over the texts counts what is left exactly, by its words.

Tasks learn frequent words and surviving n-grams from a bit filter of bounded size. What
it lets through by mistake costs work and changes no result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.llm.common import LOWER, UPPER, Shelf, lookup
from rareflow.llm.shingles import STEP, WordHashes, mixed

BREAKS = b".,;:!?\n\x0b\x0c\r"       # end a piece; "." stands for all of them
FOLD = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + b"." * len(BREAKS))
CHUNK_BYTES = 1_000_000              # texts tokenised together, cut at the end of a piece
HELD_PHRASES = 200_000               # phrases a task counts before it passes them on
PROBES = 4                           # bits per key of a filter
EXACT = "decimal(38,0)"
SHORT, KEY_BITS = np.uint64(16), 48  # keys of n-grams; equal keys only share a counter


def tokens(text: bytes) -> list[bytes]:
    """Words, with a single point where a piece ends."""
    return text.replace(b".", b" . ").split()


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, folded text) of a batch of (lang, text): texts of a language in one, long ones cut."""
    by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
    held: Counter[str] = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text, at = text.as_py().translate(FOLD), 0
        while len(text) - at > CHUNK_BYTES:
            end = text.find(b".", at + CHUNK_BYTES)
            if end < 0:
                break
            yield lang, text[at:end]
            at = end + 1
        by_lang[lang].append(text[at:])
        held[lang] += len(text) - at
        if held[lang] > CHUNK_BYTES:
            yield lang, b".".join(by_lang.pop(lang))
            del held[lang]
    for lang, texts in by_lang.items():
        yield lang, b".".join(texts)


class BitFilter:
    """Which 64-bit keys may be in a set: 16 bits per key, ``most`` bits at most."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, most: int) -> BitFilter:
        """From the column ``key``. Bits are set and merged by tasks; the driver gets the words."""
        size = 1 << 16
        while size < min(16 * keys.count(), most):
            size *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy().view(np.uint64)
                bits = np.concatenate([place(key, k, size) for k in range(PROBES)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bits >> np.uint64(6)).view(np.int64)),
                     pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))],
                    names=["slot", "bits"])

        found = (keys.select("key").mapInArrow(run, "slot long, bits long")
                 .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())
        words = np.zeros(size // 64, np.uint64)
        words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def holding(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the set."""
        at = np.arange(len(keys))
        for k in range(PROBES):
            bits = place(keys[at], k, 64 * len(self.words))
            at = at[(self.words[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1]
        return at


def place(keys: np.ndarray, probe: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys + np.uint64(probe + 1)) & np.uint64(size - 1)


def salted(hashes: np.ndarray, lang: str) -> np.ndarray:
    return hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


def grams(words: np.ndarray, good: np.ndarray, longest: int,
          pairs: BitFilter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, their keys) of the n-grams of 2 to ``longest`` words that are all good
    and whose pairs may be in ``pairs``."""
    key, whole, step = words, good, np.uint64(STEP)
    for size in range(2, min(longest, len(words)) + 1):
        count = len(words) - size + 1
        key = mixed(key[:count] * step + words[size - 1:])
        whole = whole[:count] & good[size - 1:]
        at = np.flatnonzero(whole)
        if size == 2 and pairs:
            at = at[pairs.holding(key[at] >> SHORT)]
            whole = np.zeros(count, bool)
            whole[at] = True
        if size == 2:
            good = np.append(False, whole)                   # a word ends a pair that is good
        yield size, at, key[at] >> SHORT


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words that occur ``threshold`` times or more in a language.

    Texts with A-Z in lower case are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
    ``[^\\x20\\x09]+``; a phrase stands in one piece, and overlapping occurrences count. Null and
    empty texts hold no words, a null language is ``und``; very long texts are taken whole, in
    chunks that end where a piece ends. Repeated rows and copies count as often as they occur. Ids and extra
    columns are ignored, whatever their names. Equal scores are ordered by count, then by the phrase's bytes.
    An empty table gives an empty result.
    """

    threshold: int = 100
    longest: int = 5
    percent: int = 100               # share of a phrase's occurrences inside one longer phrase
    top: int = 2000
    buffer: int = 1_500_000          # n-grams summarised at once in a task
    partition: int = 4_000_000       # mass of a hash partition, hot n-grams aside
    filter_bits: int = 1 << 27

    def find(self, docs: DataFrame, text_column: str = "text",
             lang_column: str = "lang") -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
        spark = docs.sparkSession
        shelf = Shelf(spark)
        texts = docs.select(
            F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
            F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
        words = shelf.keep(summed(texts.mapInArrow(_counted(lambda lang, hashes: tokens), COUNTED)), "words")
        sizes = shelf.keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
        frequent = words.where(F.col("f") >= self.threshold)
        candidates = shelf.keep(self._candidates(texts, sizes, frequent), "candidates")
        scored = shelf.keep(self._scored(candidates, frequent, sizes), "scored")
        return shelf.finish(self._best(scored), "phrases")

    def _candidates(self, texts: DataFrame, sizes: DataFrame, frequent: DataFrame) -> DataFrame:
        """(lang, phrase, f) of all frequent phrases of two words or more."""
        spark = texts.sparkSession
        mass = sizes.agg(F.sum("n")).first()[0] or 0
        shelf, shared = Shelf(spark), []

        def told(keys: DataFrame):
            shared.append(spark.sparkContext.broadcast(BitFilter.of(keys, self.filter_bits)))
            return shared[-1]

        def surviving(lengths: range, mass: int, known, pairs=None) -> DataFrame:
            summaries = texts.mapInArrow(self._summaries(lengths, mass, known, pairs), SUMMARY)
            merged = (summaries.repartition("part").sortWithinPartitions("part", "held")
                      .mapInArrow(self._merged(), "key long, most long"))
            return shelf.keep(merged, "surviving")

        # written first: a task with one Python node needs one Python worker
        known = told(shelf.keep(frequent.mapInArrow(_word_keys, "key long"), "keys"))
        found = surviving(range(2, 3), mass, known)
        pairs = wanted = told(found)
        if self.longest > 2:
            # a longer n-gram starts with a pair that survived
            mass = (self.longest - 2) * (found.agg(F.sum("most")).first()[0] or 0)
            longer = surviving(range(3, self.longest + 1), mass, known, pairs)
            wanted = told(found.unionByName(longer))
        counted = texts.mapInArrow(_counted(self._phrases(known, pairs, wanted)), COUNTED)
        found = shelf.finish(summed(counted).where(F.col("f") >= self.threshold), "counted")
        for each in shared:
            each.destroy()
        return found

    def _summaries(self, lengths: range, mass: int, known, pairs):
        """Summaries of buffers of n-grams, cut by the first bits of the key. Each comes after a row
        that says its mass only, so that a merging task knows the partition's mass first."""
        most, bits = self.buffer, 0
        while mass > self.partition << bits:
            bits += 1
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits)

        def summary(held: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            keys, counts = every[first], np.diff(first, append=len(every)).astype(np.uint32)
            cuts = [0, *np.searchsorted(keys, edges), len(keys)]
            short = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
            rows = [[], [], [], []]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    rows[0] += [part, part]
                    rows[1] += [int(counts[a:b].sum()), None]
                    rows[2] += [None, short[a:b].tobytes()]
                    rows[3] += [None, counts[a:b].tobytes()]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            held_first = pa.array([m is None for m in rows[1]], pa.bool_())
            arrays = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([arrays[0], held_first, *arrays[1:]],
                                              names=["part", "held", "mass", "keys", "counts"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, held, waiting = WordHashes(), [], 0
            with np.errstate(over="ignore"):
                for batch in batches:
                    for lang, text in chunks(batch):
                        words, good = _marked(tokens(text), lang, hashes, known.value)
                        for size, _, keys in grams(words, good, lengths[-1],
                                                   pairs and pairs.value):
                            if size in lengths:
                                held.append(keys)
                                waiting += len(keys)
                        if waiting > most:
                            yield summary(held)
                            waiting = 0
                if waiting:
                    yield summary(held)

        return run

    def _merged(self):
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, merging = None, None
            for batch in batches:
                for now, held, mass, keys, counts in zip(*batch.columns, strict=True):
                    if now.as_py() != part:
                        if merging:
                            yield merging.possible(threshold)
                        part, merging = now.as_py(), Summary(threshold)
                    if not held.as_py():
                        merging.mass += mass.as_py()
                    else:
                        merging.add(unpacked(keys.as_py()), np.frombuffer(counts.as_py(), np.uint32))
            if merging:
                yield merging.possible(threshold)

        return run

    def _phrases(self, known, pairs, wanted):
        """Phrases of a chunk whose keys survived, repeats included."""
        longest = self.longest

        def of(lang: str, hashes: WordHashes) -> Callable[[bytes], Iterator[bytes]]:
            def phrases(text: bytes) -> Iterator[bytes]:
                words = tokens(text)
                flat = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.append(0, ends[:-1])
                with np.errstate(over="ignore"):
                    codes, good = _marked(words, lang, hashes, known.value)
                    for size, at, keys in grams(codes, good, longest, pairs.value):
                        at = at[wanted.value.holding(keys)]
                        yield from map(flat.__getitem__, map(
                            slice, starts[at].tolist(), (ends[at + size - 1] - 1).tolist()))

            return phrases

        return of

    def _scored(self, candidates: DataFrame, frequent: DataFrame, sizes: DataFrame) -> DataFrame:
        """Candidates that no longer one covers, with their lowest-scoring cut."""
        listed = candidates.withColumn("words", F.split("phrase", " ", -1))
        last = F.size("words")
        inner = listed.where(last > 2).select("lang", "f", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), last - 1), lambda size: F.transform(
                F.sequence(F.lit(1), F.size("words") - size + 1),
                lambda at: F.array_join(F.slice("words", at, size), " "))))).alias("phrase"))
        covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        left = listed.join(covered, ["lang", "phrase"], "left").where(
            F.coalesce(100 * F.col("longer") < self.percent * F.col("f"), F.lit(True)))

        part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
        cut = F.explode(F.sequence(F.lit(1), last - 1)).alias("cut")
        parts = left.select("lang", "phrase", "f", "words", cut).select(
            "lang", "phrase", "f", "cut", F.explode(F.array(
                F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("cut")).alias("part")),
                F.struct(F.lit(False).alias("first"),
                         part(F.col("cut") + 1, last - F.col("cut")).alias("part"))
            )).alias("p")).select("lang", "phrase", F.col("f").alias("a"), "cut", "p.*")
        counts = frequent.unionByName(candidates).withColumnRenamed("phrase", "part")
        uses = parts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
        counted = lookup(parts, counts.join(uses, ["lang", "part"]), ["lang", "part"], "uses")
        cuts = counted.groupBy("lang", "phrase", "cut").agg(
            F.first("a").alias("a"), F.max(F.when(F.col("first"), F.col("f"))).alias("l"),
            F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
        uses = left.groupBy("lang").agg(F.count("*").alias("uses"))
        cuts = lookup(cuts, sizes.join(uses, "lang"), "lang", "uses").withColumn(
            "score", exact_score("a", "l", "r", "n"))
        return cuts.groupBy("lang", "phrase").agg(
            F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("low")).select(
            "lang", "phrase", *[f"low.{c}" for c in ("a", "l", "r", "n", "score")])

    def _best(self, scored: DataFrame) -> DataFrame:
        """The best of each language, ranked in buckets first: no task ranks all of a hot one."""
        order = [F.desc("score"), F.desc("a"), "phrase"]
        rows = scored.count()
        buckets = max(1, int((rows / self.top) ** 0.5))
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        near = (scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
                .withColumn("rank", rank("lang", "bucket")).where(F.col("rank") <= self.top))
        return near.withColumn("rank", rank("lang").cast("long")).where(
            F.col("rank") <= self.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COUNTED = "lang string, phrase string, f long"
SUMMARY = "part int, held boolean, mass long, keys binary, counts binary"


class Summary:
    """Counters of one hash partition; ``mass`` must be known before the first is added."""

    def __init__(self, threshold: int):
        self.threshold, self.mass, self.taken = threshold, 0, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def capacity(self) -> int:
        return self.mass // self.threshold + 1

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > max(self.capacity, 100_000):
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting = []
        order = np.argsort(every)
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else order
        self.keys = every[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        beyond = len(self.keys) - self.capacity
        if beyond > 0:
            cut = int(np.partition(self.counts, beyond - 1)[beyond - 1])
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut
            self.taken += cut

    def possible(self, threshold: int) -> pa.RecordBatch:
        """Keys that may occur ``threshold`` times, and how often at most."""
        self.merge()
        most = self.counts + self.taken
        keep = most >= threshold
        return pa.RecordBatch.from_arrays(
            [pa.array(self.keys[keep].view(np.int64)), pa.array(most[keep].astype(np.int64))],
            names=["key", "most"])


def unpacked(keys: bytes) -> np.ndarray:
    wide = np.zeros((len(keys) * 8 // KEY_BITS, 8), np.uint8)
    wide[:, :KEY_BITS // 8] = np.frombuffer(keys, np.uint8).reshape(len(wide), -1)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _marked(words: list[bytes], lang: str, hashes: WordHashes,
            known: BitFilter) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words, and which of them may be frequent; the end of a piece is not."""
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    keys = salted(codes, lang)
    good = np.zeros(len(words), bool)
    good[known.holding(keys)] = True
    return keys, good & (codes != np.uint64(hashes[b"."]))


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [int(salted(np.uint64(xxhash.xxh3_64_intdigest(word.encode())), lang))
                for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))],
                                         names=["key"])


def _counted(of: Callable[[str, WordHashes], Callable[[bytes], Iterator[bytes]]]):
    """Counts per language of what ``of(lang, word hashes of the task)`` finds in a chunk, passed on
    before they grow large."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter[bytes]] = defaultdict(Counter)
        hashes, finders = WordHashes(), {}

        def told() -> pa.RecordBatch:
            langs = [lang for lang, c in counts.items() for _ in c]
            columns = [pa.array(langs, pa.string()),
                       pa.array([p for c in counts.values() for p in c], pa.binary()).cast(pa.string()),
                       pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in chunks(batch):
                if lang not in finders:
                    finders[lang] = of(lang, hashes)
                counts[lang].update(finders[lang](text))
                counts[lang].pop(b".", None)
                if sum(map(len, counts.values())) > HELD_PHRASES:
                    yield told()
        yield told()

    return run


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def exact_score(a: str, l: str, r: str, n: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)); products are decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"(cast({wide(a)} * {wide(n)} as {EXACT}) * 1000) "
                  f"div cast({wide(l)} * {wide(r)} as {EXACT})")
