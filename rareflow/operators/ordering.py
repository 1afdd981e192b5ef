"""Exact ranks and running totals without an unpartitioned window over rows.

Two orders occur:

* hash order (sampling, shuffling, sharding): rows fall evenly into buckets by
  the first hex digits of their token, so bucket counts give global offsets;
* value order (AUROC, quantiles, vocabularies, series): rows are first reduced
  to distinct values, then range-partitioned into even slices.

In both, only bucket summaries of bounded size are scanned in one place. Sizes choose
how many buckets or slices there are, never which rows or which order come out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rareflow.functions.hashing import hash_token, row_fingerprint
from rareflow.session import materialize

PREFIX_DIGITS = 4            # 65,536 hash buckets
HOT_ROWS = 2_000_000         # largest bucket one task ranks
SLICE_ROWS = 1_000_000       # distinct values aimed at per slice
ACCURACY = 1_000             # ranks of a sketch are right within rows / ACCURACY
BRACKET_GROUPS = 100_000     # groups whose brackets are broadcast (about 15 MB)
PIECE_ROWS = 100_000         # copies of a row that one input row expands to

TOKEN, BUCKET, PRINT, WEIGHT = "__token", "__bucket", "__print", "__weight"
GROUP, SKIP = "__group", "__skip"
SMALL_RANKS = 100_000        # cutoffs that may be broadcast (4 MB)


class HashOrder:
    """Rows of ``df`` in keyed hash order, overall or within each value of ``by``.

    ``key`` should identify a row. Rows sharing a key are ordered by their
    content; exact copies are interchangeable and are counted, never spread out
    one by one in a single task.
    """

    def __init__(self, df: DataFrame, key: Column | str, seed: str, by: str | None = None,
                 hot_rows: int = HOT_ROWS, token: Column | None = None):
        self.columns = df.columns
        self.by = by
        self.hot_rows = hot_rows
        self._stats = None
        self.rows = df.withColumn(TOKEN, hash_token(key, seed) if token is None else token)
        self.rows = self.rows.withColumn(GROUP, F.col(by) if by else F.lit(0))
        self.rows = self.rows.withColumn(BUCKET, F.substring(TOKEN, 1, PREFIX_DIGITS))
        # at most 65,536 rows per group, whatever the size of df
        self.histogram = materialize(
            self.rows.groupBy(GROUP, BUCKET).agg(F.count("*").alias("n")), "order-histogram")

    def counts(self) -> dict:
        """Rows per group (metadata: one row per group)."""
        rows = self.histogram.groupBy(GROUP).agg(F.sum("n").alias("n")).collect()
        return {r[GROUP]: r["n"] for r in rows}

    def total(self) -> int:
        return sum(self.counts().values())

    def _hot_limit(self) -> float:
        """Rows above which a bucket counts as hot: never below a few even shares."""
        return max(self.hot_rows, 4 * (self._bucket_stats()["total"] or 0) / 16 ** PREFIX_DIGITS)

    def is_hot(self) -> bool:
        """Whether some bucket holds far more rows than an even share."""
        return (self._bucket_stats()["top"] or 0) > self._hot_limit()

    def _bucket_stats(self):
        if self._stats is None:
            self._stats = self.histogram.agg(
                F.sum("n").alias("total"), F.max("n").alias("top")).first()
        return self._stats

    # -- exact-k selection -------------------------------------------------

    def _wanted(self, k: int | Mapping) -> dict:
        counts = self.counts()
        wanted = k if isinstance(k, Mapping) else {g: k for g in counts}
        for group, size in wanted.items():
            if size > counts.get(group, 0):
                raise ValueError(
                    f"group {group!r} has {counts.get(group, 0)} rows, {size} were asked for")
            if size < 0:
                raise ValueError("sample size must not be negative")
        return dict(wanted)

    def _cutoffs(self, wanted: dict) -> dict:
        """Per group (last token, rows wanted at that token, rows there)."""
        ask = {g: k for g, k in wanted.items() if k > 0}
        if not ask:
            return {}
        target = _lookup(F.col(GROUP), ask)
        in_order = Window.partitionBy(GROUP).orderBy(BUCKET)
        edges = (
            self.histogram.withColumn("upto", F.sum("n").over(in_order))
            .filter((F.col("upto") >= target) & (F.col("upto") - F.col("n") < target))
            .select(GROUP, BUCKET, (target - F.col("upto") + F.col("n")).alias("left"))
            .collect()
        )
        left = {r[GROUP]: r["left"] for r in edges}
        bucket = _lookup(F.col(GROUP), {r[GROUP]: r[BUCKET] for r in edges}, "string")
        tokens = (self.rows.filter(F.col(BUCKET) == bucket)
                  .groupBy(GROUP, TOKEN).agg(F.count("*").alias("n")))
        by_token = Window.partitionBy(GROUP).orderBy(TOKEN)
        need = _lookup(F.col(GROUP), left)
        hits = (
            tokens.withColumn("upto", F.sum("n").over(by_token))
            .filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
            .select(GROUP, TOKEN, "n", (need - F.col("upto") + F.col("n")).alias("left"))
            .collect()
        )
        return {r[GROUP]: (r[TOKEN], r["left"], r["n"]) for r in hits}

    def split(self, k: int | Mapping) -> tuple[DataFrame, DataFrame]:
        """(the k first rows of each group, the other rows of those groups).

        Both are plain filters on the token: no row is shuffled. Only rows that
        tie at the cutoff are handled apart.
        """
        wanted = self._wanted(k)
        cuts = self._cutoffs(wanted)
        # one comparison per row: "" is below and "g" above every token
        last = {g: cuts[g][0] if g in cuts else "" for g in wanted}
        cut = _lookup(F.col(GROUP), last, "string")
        whole = {g: token for g, (token, left, n) in cuts.items() if left == n}
        taken = self.rows.filter(F.col(TOKEN) <= cut) if len(whole) == len(cuts) else \
            self.rows.filter(F.col(TOKEN) < _lookup(
                F.col(GROUP), {g: t + "g" if g in whole else t for g, t in last.items()}, "string"))
        taken = taken.select(*self.columns)
        others = self.rows.filter(F.col(TOKEN) > cut).select(*self.columns)
        for group, (token, left, n) in cuts.items():
            if group not in whole:
                tied = F.col(GROUP).eqNullSafe(F.lit(group)) & (F.col(TOKEN) == F.lit(token))
                some, more = self._split_tied(self.rows.filter(tied), left)
                taken, others = taken.unionByName(some), others.unionByName(more)
        return taken, others

    def mark(self, k: int | Mapping, name: str) -> DataFrame:
        """All rows of the groups in one pass; ``name`` is 1 for the first k, else 0."""
        wanted = self._wanted(k)
        cuts = self._cutoffs(wanted)
        if any(left < n for _, left, n in cuts.values()):
            taken, others = self.split(wanted)
            return taken.withColumn(name, F.lit(1)).unionByName(
                others.withColumn(name, F.lit(0)))
        last = {g: cuts[g][0] if g in cuts else "" for g in wanted}
        cut = _lookup(F.col(GROUP), last, "string")
        return (self.rows.select(*self.columns, (F.col(TOKEN) <= cut).cast("int").alias(name))
                .filter(F.col(name).isNotNull()))

    def take(self, k: int | Mapping) -> DataFrame:
        return self.split(k)[0]

    def _split_tied(self, rows: DataFrame, left: int) -> tuple[DataFrame, DataFrame]:
        """Rows sharing one key: order by content, then count out exact copies."""
        rows = rows.select(*self.columns)
        prints = HashOrder(rows, F.lit(""), "", hot_rows=self.hot_rows,
                           token=row_fingerprint(self.columns))
        token, keep, n = prints._cutoffs({0: left})[0]
        at = F.col(TOKEN) == F.lit(token)
        below = prints.rows.filter(F.col(TOKEN) < F.lit(token)).select(*self.columns)
        above = prints.rows.filter(F.col(TOKEN) > F.lit(token)).select(*self.columns)
        copies = (prints.rows.filter(at).select(*self.columns)
                  .groupBy(*self.columns).agg(F.count("*").alias(WEIGHT)))
        # equal fingerprints mean equal rows, so this is one row of weight n
        kept = repeated(copies.withColumn(WEIGHT, F.lit(keep)), WEIGHT)
        left_out = repeated(copies.withColumn(WEIGHT, F.lit(n - keep)), WEIGHT)
        return below.unionByName(kept), above.unionByName(left_out)

    def passed(self, ranks: Mapping[object, Sequence[int]], name: str, piece: str | None = None,
               piece_rows: int = 0) -> DataFrame:
        """``name``: how many of its group's (rising) ranks lie before a row's 1-based rank.

        The ranks are turned into tokens by the histogram, so the column is a projection:
        no row is shuffled. Only if rows tie at a cutoff are positions needed. ``piece`` names a
        column to number stretches of about ``piece_rows`` consecutive rows: whole buckets, or
        by position if one key holds many rows.
        """
        kind = self.rows.schema[GROUP].dataType.simpleString()
        asked = self.rows.sparkSession.createDataFrame(
            [(g, i, int(k)) for g, ks in ranks.items() for i, k in enumerate(ks)],
            f"{GROUP} {kind}, i int, rank bigint")
        upto = F.sum("n").over(Window.partitionBy(GROUP).orderBy(BUCKET))
        buckets = self.histogram.select(GROUP, BUCKET, (upto - F.col("n")).alias("low"),
                                        upto.alias("high"))
        hit = null_safe_join(asked, buckets, [GROUP]).where("rank > low and rank <= high")
        hit = materialize(hit, "order-ranks")              # a row per rank
        tokens = null_safe_join(self.rows.select(GROUP, BUCKET, TOKEN),
                                hit.select(GROUP, BUCKET).distinct(), [GROUP, BUCKET])
        counted = tokens.groupBy(GROUP, BUCKET, TOKEN).agg(F.count("*").alias("n"))
        inside = F.sum("n").over(Window.partitionBy(GROUP, BUCKET).orderBy(TOKEN))
        counted = counted.withColumn("inside", inside)
        cuts = null_safe_join(hit, counted, [GROUP, BUCKET]).where(
            "rank > low + inside - n and rank <= low + inside")
        cuts = materialize(cuts.select(GROUP, "i", TOKEN, (
            F.col("rank") < F.col("low") + F.col("inside")).alias("tied")), "order-cuts")
        if cuts.filter("tied").isEmpty() and not (piece and self.is_hot()):
            low = asked.where("rank <= 0").select(GROUP, "i", F.lit("").alias(TOKEN))
            arrays = cuts.drop("tied").unionByName(low).groupBy(GROUP).agg(
                F.collect_list(TOKEN).alias("__cuts"))
            if sum(len(ks) for ks in ranks.values()) <= SMALL_RANKS:
                arrays = F.broadcast(arrays)
            before = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<string>")),
                                     lambda c: c < F.col(TOKEN)))
            rows, more = self.rows, []
            if piece:
                starts = self._offsets(self.histogram)
                if len(ranks) == 1:                        # one group has at most 65,536 buckets
                    starts = F.broadcast(starts)
                rows, more = _with_offsets(rows, starts), [F.floor(F.col("offset") / piece_rows).alias(piece)]
            return null_safe_join(rows, arrays, [GROUP], "left").select(
                *self.columns, before.alias(name), *more)
        arrays = asked.groupBy(GROUP).agg(F.collect_list("rank").alias("__ranks"))
        placed = self.positions("__at").withColumn(GROUP, F.col(self.by) if self.by else F.lit(0))
        before = F.size(F.filter(F.coalesce("__ranks", F.array().cast("array<bigint>")),
                                 lambda k: k <= F.col("__at")))
        more = [F.floor(F.col("__at") / piece_rows).alias(piece)] if piece else []
        return null_safe_join(placed, arrays, [GROUP], "left").select(
            *self.columns, before.alias(name), *more)

    # -- global positions --------------------------------------------------

    def positions(self, name: str = "position") -> DataFrame:
        """Every row with its 0-based position in hash order within its group.

        Content orders rows that share a token, in hot prefixes and elsewhere.
        """
        if not self.is_hot():
            return self._number(self.rows, self.histogram, name)
        limit = self._hot_limit()
        # hot prefixes: one key holds many rows. Collapse exact copies, then cut
        # the prefix by token and content.
        hot = [r[BUCKET] for r in
               self.histogram.filter(F.col("n") > limit).select(BUCKET).distinct().collect()]
        is_hot = F.col(BUCKET).isin(hot)
        finer = F.concat(F.col(TOKEN), F.lit("|"), F.substring(PRINT, 1, PREFIX_DIGITS))
        folded = materialize(
            self.rows.filter(is_hot).withColumn(PRINT, row_fingerprint(self.columns))
            .groupBy(*self.columns, GROUP, TOKEN, PRINT).agg(F.count("*").alias(WEIGHT))
            .withColumn(BUCKET, finer), "order-hot")
        sizes = folded.groupBy(GROUP, BUCKET).agg(F.sum(WEIGHT).alias("n"))
        histogram = self.histogram.filter(~is_hot).unionByName(sizes)
        cold = self._number(self.rows.filter(~is_hot), histogram, name)
        offsets = self._offsets(histogram)
        inside = Window.partitionBy(GROUP, BUCKET).orderBy(TOKEN, PRINT)
        start = F.col("offset") + F.sum(WEIGHT).over(inside) - F.col(WEIGHT)
        placed = _with_offsets(folded, offsets).withColumn("start", start)
        spread = (in_pieces(placed, WEIGHT).withColumn("start", F.col("start") + F.col(SKIP))
                  .select(*self.columns,
                          F.explode(F.sequence(F.col("start"), F.col("start") + F.col(WEIGHT) - 1))
                          .alias(name)))
        return cold.unionByName(spread)

    @staticmethod
    def _offsets(histogram: DataFrame) -> DataFrame:
        before = Window.partitionBy(GROUP).orderBy(BUCKET)
        return histogram.select(
            GROUP, BUCKET, (F.sum("n").over(before) - F.col("n")).alias("offset"))

    def _number(self, rows: DataFrame, histogram: DataFrame, name: str) -> DataFrame:
        inside = Window.partitionBy(GROUP, BUCKET).orderBy(TOKEN, PRINT)
        return (
            _with_offsets(rows, self._offsets(histogram))
            .withColumn(PRINT, row_fingerprint(self.columns))
            .withColumn(name, F.col("offset") + F.row_number().over(inside) - 1)
            .select(*self.columns, name)
        )


def _with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Join on group and bucket; rows without a group are kept."""
    right = offsets.select(F.col(GROUP).alias("__g"), F.col(BUCKET).alias("__b"), "offset")
    same = F.col(GROUP).eqNullSafe(F.col("__g")) & (F.col(BUCKET) == F.col("__b"))
    return rows.join(right, same).drop("__g", "__b")


def _lookup(col: Column, values: Mapping, kind: str = "bigint") -> Column:
    """Small literal lookup, NULL for absent keys."""
    out = F.lit(None).cast(kind)
    for key, value in values.items():
        out = F.when(col.eqNullSafe(F.lit(key)), F.lit(value).cast(kind)).otherwise(out)
    return out


def in_pieces(df: DataFrame, times: str) -> DataFrame:
    """Rows of weight ``times`` as rows of at most ``PIECE_ROWS``, dealt out anew; ``SKIP`` is
    the weight before a piece."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(PIECE_ROWS).cast("bigint"))
    return (df.filter(F.col(times) > 0).withColumn(SKIP, F.explode(starts))
            .withColumn(times, F.least(F.lit(PIECE_ROWS), F.col(times) - F.col(SKIP)))
            .repartition(F.xxhash64(SKIP, *df.columns)))


def expanded(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, in place."""
    return (df.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))))
            .drop(times, "__copy"))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says (0 drops it)."""
    return expanded(in_pieces(df, times).drop(SKIP), times)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
                   ) -> DataFrame:
    """Equi-join in which NULL keys meet; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


# -- value order -------------------------------------------------------------


def value_buckets(values: DataFrame, by: list[str], order: str,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``BUCKET``: even, order-preserving slices of each group.

    ``values`` must hold distinct (by, order) rows and be cheap to read again
    (a written table). Spark's range partitioning makes as many slices as the
    rows need; they are written with the rows, so that all later steps see the
    same ones.
    """
    slices = _slices(values, slice_rows)
    placed = values.repartitionByRange(slices, *by, order).withColumn(
        BUCKET, F.spark_partition_id())
    return materialize(placed, "value-slices")


def _slices(values: DataFrame, slice_rows: int) -> int:
    return max(1, -(-values.count() // max(1, slice_rows)))


def running_before(values: DataFrame, by: list[str], order: str, sums: list[str],
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each column s of ``sums`` add ``s_before`` (total of s over smaller
    order values of the group) and ``s_total`` (over the whole group).

    A table of one slice is not written again: its windows are the slice's.
    """
    if _slices(values, slice_rows) == 1:
        whole = Window.partitionBy(*(by or [F.lit(0)]))
        rising = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return values.select(
            *values.columns,
            *[(F.sum(s).over(rising) - F.col(s)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums])
    cut = value_buckets(values, by, order, slice_rows)
    slices = cut.groupBy(*by, BUCKET).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    # one row per group and range partition it touches
    slices = slices.withColumn(GROUP, F.lit(0))
    inside = Window.partitionBy(GROUP, *by)
    upto = inside.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    offsets = slices.select(
        *by, BUCKET,
        *[(F.sum(f"__{s}").over(upto) - F.col(f"__{s}")).alias(f"__{s}_off") for s in sums],
        *[F.sum(f"__{s}").over(inside).alias(f"{s}_total") for s in sums])
    local = (Window.partitionBy(*by, BUCKET).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, 0))
    return null_safe_join(cut, offsets, [*by, BUCKET]).select(
        *values.columns,
        *[(F.col(f"__{s}_off") + F.sum(s).over(local) - F.col(s)).alias(f"{s}_before")
          for s in sums],
        *[f"{s}_total" for s in sums])


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n) of the non-null values, as a written table."""
    return materialize(
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")),
        "value-counts")


def moments_and_quantiles(df: DataFrame, by: list[str], value: str, probs: Mapping[str, float],
                          accuracy: int = ACCURACY, slice_rows: int = SLICE_ROWS,
                          bracket_groups: int = BRACKET_GROUPS) -> DataFrame:
    """n, mean, sample std, min, max and exact quantiles of the non-null values of each group.

    The first read of ``df`` brackets each wanted rank by a sketch. The second counts the
    values inside the brackets one by one and folds each run of values between them into one
    row, so only a small part of the values is ranked. A group with a rank outside its bracket
    is ranked whole, as are all groups if there are too many to broadcast their brackets.
    """
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*by, value)
    ends = [[p + side * 2.0 / accuracy for p in probs.values()] for side in (-1, 1)]
    at = [min(max(p, 0.0), 1.0) for side in ends for p in side]
    stats = materialize(
        rows.groupBy(*by).agg(
            F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v, at, accuracy).alias("__at")), "moments")
    out = stats.drop("__at")
    if stats.count() > bracket_groups:
        return null_safe_join(out, exact_quantiles(rows, by, value, probs, slice_rows), by)

    edges = stats.select(*by, *[
        (F.col("min") if p <= 0 else F.col("max") if p >= 1 else F.get("__at", F.lit(i)))
        .alias(f"__edge{i}") for i, p in enumerate(at)])
    lows = [F.col(f"__edge{i}") for i in range(len(probs))]
    highs = [F.col(f"__edge{i + len(probs)}") for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in zip(lows, highs, strict=True)])
    gap = reduce(lambda a, b: a + b, [(v > hi).cast("int") for hi in highs])
    cells = materialize(
        null_safe_join(rows, F.broadcast(edges), by)
        .groupBy(*by, gap.alias("__gap"), F.when(inside, v).alias("__inside"))
        .agg(F.min(v).alias(value), F.max(v).alias("__top"), F.count("*").alias("n"))
        .drop("__gap", "__inside"), "value-cells")
    found = counted_quantiles(cells, by, value, probs, slice_rows, top="__top")
    missed = found.filter("missed").select(*by)
    found = found.filter("not missed").drop("missed")
    if not missed.isEmpty():
        other = missed.withColumnsRenamed({c: f"__missed_{c}" for c in by})
        same = reduce(lambda a, b: a & b,
                      [F.col(c).eqNullSafe(F.col(f"__missed_{c}")) for c in by])
        again = rows.join(F.broadcast(other), same, "left_semi")
        found = found.unionByName(exact_quantiles(again, by, value, probs, slice_rows))
    return null_safe_join(out, found, by)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: Mapping[str, float],
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of the non-null values of each group."""
    return counted_quantiles(counted_values(df, by, value), by, value, probs, slice_rows)


def counted_quantiles(counted: DataFrame, by: list[str], value: str, probs: Mapping[str, float],
                      slice_rows: int = SLICE_ROWS, top: str | None = None) -> DataFrame:
    """The same from a table of counted values.

    With ``top`` a row may stand for several values, from ``value`` to ``top``; the column ``missed``
    then says whether a wanted rank lies in such a row.
    """
    ranked = running_before(counted, by, value, ["n"], slice_rows)
    aggs, hits = [], []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, pos in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n"))
            hits.append(hit)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{side}"))
    if top is not None:
        wide = reduce(lambda a, b: a | b, hits) & (F.col(top) != F.col(value))
        aggs.append(F.max(wide).alias("missed"))
    grouped = ranked.groupBy(*by).agg(F.max("n_total").alias("__n"), *aggs)
    outs = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        outs.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return grouped.select(*by, *outs, *(["missed"] if top is not None else []))
