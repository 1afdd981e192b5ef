"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies. Documents stand in an
order of size classes and, within one, of a hash; the running sum of expected copies plus
one random offset per source crosses an integer once per copy. Neighbours in the order are alike
in size, so the words taken come near the target. The running sum is a rank: counts per
(source, size class, hash bucket), a table bounded by the sources, give the offsets,
and only the rows of one bucket are ranked in one place. Texts are counted once: the sized rows
are written, and the counts read no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.llm.common import Shelf, shielded

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Copies of documents such that sources reach weighted shares of all words.

    Sources stand by code point, null last, and weigh ``weights`` in turn. A target stops
    at ``most`` times its source's words; the excess goes to the others by weight.
    Null and empty texts have size 0 and take part with it; documents with equal hashes
    are ordered by content, equal rows are interchangeable. Very long texts are counted whole.
    Columns named like a new one are replaced. An empty table gives an empty result.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    digits: int = 2              # hex digits of the hash that make a bucket
    seed: str = "mix"

    def targets(self, sized: DataFrame) -> DataFrame:
        """(source, source_size, target) from rows of (source, size)."""
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        ordered = Window.orderBy(F.col("source").asc_nulls_last())   # a row per source
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        weighed = totals.withColumn("weight", F.get(weights, ((
            F.row_number().over(ordered) - 1) % len(self.weights)).cast("int")))
        # water-filling: sources reach their limits in the order of limit / weight
        weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(self.most)))
        weighed = weighed.withColumn("fill", F.col("limit") / F.col("weight"))
        rising = Window.orderBy("fill", F.col("source").asc_nulls_last())
        before = rising.rowsBetween(Window.unboundedPreceding, -1)
        onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rest = (F.sum("source_size").over(whole).cast("double")
                - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        levelled = weighed.withColumn("level", rest / F.sum("weight").over(onward))
        final = F.first(F.when(F.col("fill") >= F.col("level"), F.col("level")), True).over(whole)
        return levelled.withColumn("final", F.coalesce(final, F.lit(0.0))).select(
            "source", "source_size", F.least("limit", F.col("weight") * F.col("final"))
            .alias("target"))

    def copies(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               source_column: str = "source", texts: bool = True) -> DataFrame:
        """``docs`` with size, source_size, target and copies, which replace columns so named.

        Without ``texts`` the text column is left out, and no text is moved or written.
        """
        return shielded(docs, [id_column, text_column, source_column],
                        lambda base: self._copies(base, id_column, text_column, source_column, texts),
                        ["size", "source_size", "target", "copies"])

    def _copies(self, base: DataFrame, id_column: str, text_column: str, source_column: str,
                texts: bool) -> DataFrame:
        words = F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")
        key = F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col(id_column).cast("string"),
                                                         F.lit("null")))
        rows = base.withColumn("size", words).withColumns({
            "__token": F.md5(key.cast("binary")),
            "__content": F.xxhash64(F.col(text_column)), "__source": F.col(source_column)})
        rows = rows.withColumns({"__class": size_class(F.col("size")),
                                 "__bucket": F.substring("__token", 1, self.digits)})
        names = [c for c in base.columns if texts or c != text_column]
        rows = Shelf(base.sparkSession).keep(rows.select(
            *[quoted(c) for c in names], "size", "__token", "__content", "__source", "__class",
            "__bucket"), "mix-sized")
        cells = rows.groupBy("__source", "__class", "__bucket").agg(
            F.count("*").alias("__n"), F.sum("size").alias("__words"))
        targets = self.targets(cells.select(F.col("__source").alias("source"),
                                            F.col("__words").alias("size")))
        ordered = (Window.partitionBy("__source").orderBy("__class", "__bucket")
                   .rowsBetween(Window.unboundedPreceding, -1))
        start = F.coalesce(F.sum("__n").over(ordered), F.lit(0))
        cells = cells.withColumn("__start", start).drop("__n", "__words")
        cells = cells.join(targets, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
        rank = F.row_number().over(Window.partitionBy("__source", "__class", "__bucket")
                                   .orderBy("__token", "__content"))
        placed = rows.withColumn("__rank", rank).alias("r").join(
            cells.alias("c"), F.col("r.__source").eqNullSafe(F.col("c.__source"))
            & (F.col("r.__class") == F.col("c.__class"))
            & (F.col("r.__bucket") == F.col("c.__bucket")))
        share = F.when(F.col("source_size") > 0, F.least(
            F.col("target") / F.col("source_size"), F.lit(float(self.most)))).otherwise(0.0)
        offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{self.seed}:offset:"), F.coalesce(
            F.col("r.__source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 2 ** 32
        position = F.col("__start") + F.col("__rank")
        crossed = (F.floor(offset + share * position)
                   - F.floor(offset + share * (position - 1))).cast("long")
        return placed.select(*[F.col(f"r.{quoted(c)}") for c in names], "size",
                             "source_size", "target",
                             F.least(crossed, F.lit(self.most).cast("long")).alias("copies"))


def size_class(size: Column) -> Column:
    """Classes whose sizes differ by an eighth at most, by the leading four bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(
        bits * 16 + F.floor(size / F.pow(F.lit(2.0), bits - 4)).cast("long"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as its copies.

    The number of each copy is in ``copy``, or in ``copy_``, ``copy__``, ... if there is a column so named.
    """
    number = "copy"
    while number in [c.lower() for c in docs.columns]:
        number += "_"

    def each(base: DataFrame) -> DataFrame:
        counted = Mix(**settings).copies(base).where("copies > 0")
        upto = F.sequence(F.lit(1).cast("long"), F.col("copies"))
        return counted.withColumn(number, F.explode(upto)).select(*base.columns, number)

    return shielded(docs, ["doc_id", "text", "source"], each)
