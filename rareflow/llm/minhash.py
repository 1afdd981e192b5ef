"""Near-duplicates by b-bit MinHash.

Minima of 128 hash orders give 32 bands of four for candidates, and four low bits
each for a packed signature of 512 bits. Two texts at similarity 0.75 miss all bands
with probability 5e-6. The signature's share of equal minima, corrected for chance
collisions, drops candidates more than five deviations below the threshold; what
is left is confirmed on whole shingle sets.

Texts with equal shingle sets are folded first. Of texts that share a bucket, the
shingles no other such text has are counted: a text cannot share them, which bounds its similarity
to any other and drops far variants at once. Each text is then compared with
one hub, the text of its buckets with the smallest such share, so a group of thousands
of copies costs a pair per member. Buckets whose members are still in different groups compare
with one hub each, and then all members in different groups, in blocks. Members that met the same hub know
which of its shingles they share, as a bitmap, so what two of them can have in common
follows from the bits both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rareflow.llm.common import Shelf, components, small_batches, star_blocks
from rareflow.llm.shingles import WordHashes, mixed, shingles

SIGNED = ("id long, n long, first long, second long, bands array<long>, bits array<long>")


@dataclass(frozen=True)
class NearDuplicates:
    """Documents whose shingle sets meet ``percent`` are linked.

    Null and empty texts have no shingles and are linked with nothing, as are rows
    without an id; very long texts are hashed in chunks; repeated rows are repeated in
    the result. Extra columns are ignored. An empty table gives an empty result.
    """

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    margin: float = 0.22         # five and a half deviations of the estimate at 0.75
    block: int = 2048            # bucket members compared within one task
    seed: int = 7

    @property
    def orders(self) -> int:
        return self.bands * self.rows

    def _sign(self):
        orders, bands, rows, size = self.orders, self.bands, self.rows, self.words
        if orders % 16:
            raise ValueError("bands x rows must be a multiple of 16")
        random = np.random.default_rng(self.seed)
        factor = random.integers(0, 2 ** 32, orders, np.uint32) | np.uint32(1)
        shift = random.integers(0, 2 ** 32, orders, np.uint32)
        weight = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        place = mixed(np.arange(1001, bands + 1001, dtype=np.uint64))
        salts = mixed(np.array([11, 12], np.uint64))
        nibble = np.uint64(4) * np.arange(16, dtype=np.uint64)

        def minima(found: np.ndarray) -> np.ndarray:
            low = np.full(orders, 0xFFFFFFFF, np.uint32)
            short = (found >> np.uint64(32)).astype(np.uint32)
            for start in range(0, len(short), 1024):
                part = short[start:start + 1024, None] * factor + shift
                np.minimum(low, part.min(axis=0), out=low)
            return low.astype(np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            with np.errstate(over="ignore"):
                for batch in batches:
                    count = batch.num_rows
                    sizes = np.zeros(count, np.int64)
                    prints = np.zeros((2, count), np.uint64)
                    keys = np.zeros((count, bands), np.uint64)
                    bits = np.zeros((count, orders // 16), np.uint64)
                    for i, text in enumerate(batch.column("text")):
                        found = shingles(hashes.of(text.as_py()), size)
                        sizes[i] = len(found)
                        if not len(found):
                            continue
                        low = minima(found)
                        keys[i] = mixed((low.reshape(bands, rows) * weight).sum(axis=1) + place)
                        few = mixed(low + np.uint64(1)) & np.uint64(15)
                        bits[i] = (few.reshape(-1, 16) << nibble).sum(axis=1)
                        for j in (0, 1):
                            prints[j, i] = mixed(found ^ salts[j]).sum()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(sizes), pa.array(prints[0].view(np.int64)),
                         pa.array(prints[1].view(np.int64)), lists(keys), lists(bits)],
                        names=["id", "n", "first", "second", "bands", "bits"])

        return run

    def _agreeing(self, a: Column, b: Column) -> Column:
        """Estimated similarity of two packed signatures."""
        differing = F.lit(0)
        ones = F.lit(0x1111111111111111)
        for i in range(self.orders // 16):
            x = a[i].bitwiseXOR(b[i])
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            differing = differing + F.bit_count(x.bitwiseAND(ones))
        equal = 1 - differing / self.orders
        return (equal - 1 / 16) / (1 - 1 / 16)

    def _enough(self, most: Column, x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return 100 * most >= self.percent * (n + m - most)

    def _likely(self, x: str, y: str) -> Column:
        """Sizes, shareable shingles and signatures allow the threshold."""
        most = F.least(F.col(f"{x}.common"), F.col(f"{y}.common"))
        return (self._enough(most, x, y)
                & (self._agreeing(F.col(f"{x}.bits"), F.col(f"{y}.bits"))
                   >= self.percent / 100 - self.margin))

    def _possible(self, x: str, y: str) -> Column:
        """The bitmaps of members of one hub allow the threshold."""
        col = lambda side, name: F.col(f"{side}.{name}")
        both = F.aggregate(F.zip_with(col(x, "map"), col(y, "map"), lambda a, b: F.bit_count(
            a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
        beyond = F.least(*[col(side, "common") - col(side, "shared") for side in (x, y)])
        same = F.coalesce(col(x, "hub") == col(y, "hub"), F.lit(False))
        return F.when(same, self._enough(both + F.greatest(beyond, F.lit(0)), x, y)).otherwise(True)

    def _shareable(self, texts: DataFrame) -> DataFrame:
        """(id, alone): shingles of each text that no other one has."""
        size = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            with np.errstate(over="ignore"):
                for batch in batches:
                    found = [shingles(hashes.of(t.as_py()), size) for t in batch.column(1)]
                    own = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
                    every = np.concatenate(found) if found else np.empty(0, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), pa.array(every.view(np.int64))], names=["id", "shingle"])

        return (texts.mapInArrow(run, "id long, shingle long")
                .groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last"))
                .where("id = last").groupBy("id").agg(F.count("*").alias("alone")))

    def _compared(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, linked, shared, bits of ``a``'s shingles that ``b`` has), from full sets."""
        size, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, at, hubs = WordHashes(), None, []
            for batch in batches:
                rows = []
                for a, block, b, text in zip(*batch.columns, strict=True):
                    a, block, b = a.as_py(), block.as_py(), b.as_py()
                    with np.errstate(over="ignore"):
                        found = shingles(hashes.of(text.as_py()), size)
                    if (a, block) != at:
                        at, hubs = (a, block), []
                    if b is None:
                        hubs.append(found)
                        continue
                    marks = [has(found, hub) for hub in hubs]
                    linked = any(similar(hub, found, int(m.sum()), percent)
                                 for hub, m in zip(hubs, marks, strict=True))
                    # an id with several rows has no bitmap of its own
                    alone = len(hubs) == 1
                    rows.append((a, b, linked, int(marks[0].sum()) if alone else None,
                                 packed(marks[0]) if alone else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                        (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))],
                    names=["a", "b", "linked", "shared", "map"])

        return star_blocks(pairs, texts, ["text"]).mapInArrow(
            run, "a long, b long, linked boolean, shared long, map array<long>")

    def _confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return self._compared(pairs, texts).where("linked").select("a", "b")

    def groups(self, docs: DataFrame, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``."""
        spark = docs.sparkSession
        shelf = Shelf(spark)
        small_batches(spark)
        texts = docs.select(F.col(id_column).cast("long").alias("id"),
                            F.col(text_column).alias("text"))
        signed = shelf.keep(texts.mapInArrow(self._sign(), SIGNED), "signed")
        real = signed.where("id is not null and n > 0")
        folded = shelf.keep(real.groupBy("first", "second", "n").agg(F.min("id").alias("rep")),
                            "folded")
        member = (real.select("id", "first", "second", "n")
                  .join(folded, ["first", "second", "n"]).select("id", "rep"))
        # a row per text that differs; an id with two texts ties both together
        reps = shelf.keep(
            real.join(folded.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
            .dropDuplicates(["id", "first", "second"]).select("id", "n", "bands", "bits"), "texts")
        twofold = (member.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
                   .where("low < high"))
        links = twofold.select(F.col("low").alias("a"), F.col("high").alias("b"))
        links = shelf.keep(links.unionByName(member.join(twofold, "id").select(
            F.col("rep").alias("a"), F.col("low").alias("b"))).distinct(), "links")

        # ids with several texts, folded with others or not, have no counts or bitmaps of their own
        several = twofold.select("id").unionByName(reps.groupBy("id").agg(
            F.count("*").alias("texts")).where("texts > 1").select("id")).distinct()
        buckets = reps.select("id", F.explode("bands").alias("key"))
        many = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        buckets = shelf.keep(buckets.join(many, "key"), "buckets")
        # from here on only texts that share a bucket move
        texts = shelf.keep(texts.join(buckets.select("id").distinct().hint("merge"), "id",
                                      "left_semi"), "close")
        alone = self._shareable(texts).join(several, "id", "left_anti")
        # what a text can share at most; texts that cannot reach the threshold are done
        able = reps.join(buckets.select("id").distinct(), "id", "left_semi").join(
            alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
        able = shelf.keep(able.where(F.col("common") * 100 >= self.percent * F.col("n"))
                          .select("id", "n", "common", "bits"), "able")
        buckets = shelf.keep(buckets.join(able.select("id", "n", "common"), "id"), "open")

        tested = self._with_hub(buckets.withColumn("own", F.col("id")), one_each=True)
        tested = shelf.keep(self._plausible(tested, able), "pairs")
        met = shelf.keep(self._compared(tested, texts), "compared")
        links = links.unionByName(met.where("linked").select("a", "b"))
        whole = components(shelf, links)
        # without a bitmap nothing bounds a pair, so such members count as without a hub
        maps = met.where("map is not null").join(
            several, met["b"] == several["id"], "left_anti").select(
            F.col("b").alias("id"), F.col("a").alias("hub"), "shared", "map").dropDuplicates(["id"])
        able = able.join(maps, "id", "left")
        for pairs_of in (self._with_hub, self._across):
            placed = buckets.join(whole, F.col("id") == F.col("node"), "left").withColumn(
                "own", F.coalesce("component", "id"))
            pairs = (pairs_of(placed) if pairs_of == self._with_hub
                     else pairs_of(placed, able)).join(tested, ["a", "b"], "left_anti")
            pairs = shelf.keep(self._plausible(pairs, able), "pairs")
            if pairs.isEmpty():
                continue
            found = shelf.keep(self._confirmed(pairs, texts), "links")
            tested = tested.unionByName(pairs)
            if not found.isEmpty():
                links = links.unionByName(found)
                whole = components(shelf, links)
        placed = (member.join(whole, F.col("rep") == F.col("node"), "left")
                  .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
        result = signed.select("id", "n").join(placed, "id", "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "id").alias("component_id"))
        return shelf.finish(result.withColumn(
            "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))), "groups")

    def _plausible(self, pairs: DataFrame, able: DataFrame) -> DataFrame:
        return (pairs.join(able.alias("x"), F.col("a") == F.col("x.id"))
                .join(able.alias("y"), F.col("b") == F.col("y.id"))
                .where(self._likely("x", "y")).select("a", "b").distinct())

    def _with_hub(self, placed: DataFrame, one_each: bool = False) -> DataFrame:
        """Members with the hub of their bucket, if still apart; or each with its best hub only."""
        order = F.struct((1 - F.col("common") / F.col("n")).alias("alone"),
                         F.xxhash64("id").alias("mark"), F.col("id").alias("hub"))
        hubs = (placed.withColumn("order", order).groupBy("key").agg(
            F.min(F.struct("order", F.col("own").alias("hub_own"))).alias("h"),
            F.min("own").alias("low"), F.max("own").alias("high"))
            .where("low < high").select("key", "h.order", "h.hub_own"))
        pairs = placed.select("key", "id", "own").join(hubs, "key").where("own <> hub_own")
        if one_each:
            pairs = pairs.groupBy("id").agg(F.min("order").alias("order"))
        return pairs.select(F.col("order.hub").alias("a"), F.col("id").alias("b")).distinct()

    def _across(self, placed: DataFrame, able: DataFrame) -> DataFrame:
        """Likely pairs of different groups that share a bucket, block against block."""
        open_keys = (placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"))
                     .where("low < high").select("key"))
        rows = (placed.join(open_keys, "key").select("key", "id", "own", "members")
                .join(able, "id"))
        blocks = F.ceil(F.col("members") / self.block)
        rows = rows.withColumns({"mine": F.pmod(F.xxhash64("id"), blocks),
                                 "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
        left = rows.withColumnsRenamed({"mine": "i", "other": "j"}).alias("x")
        right = rows.withColumnsRenamed({"mine": "j", "other": "i"}).alias("y")
        near = ((F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i"))
                & (F.col("x.j") == F.col("y.j")) & (F.col("x.id") < F.col("y.id"))
                & (F.col("x.own") != F.col("y.own")) & self._likely("x", "y")
                & self._possible("x", "y"))
        return left.join(right, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def has(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which numbers of ``two`` the sorted ``one`` holds."""
    if not len(one):
        return np.zeros(len(two), bool)
    place = np.minimum(np.searchsorted(one, two), len(one) - 1)
    return one[place] == two


def similar(one: np.ndarray, two: np.ndarray, shared: int, percent: int) -> bool:
    return bool(shared) and 100 * shared >= percent * (len(one) + len(two) - shared)


def packed(marks: np.ndarray) -> list[int]:
    """Marks as bits of 64-bit numbers."""
    bits = np.packbits(marks, bitorder="little")
    return np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(np.int64).tolist()


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix of 64-bit numbers as a list per row."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates. Columns stay."""
    groups = NearDuplicates(**settings).groups(docs)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
