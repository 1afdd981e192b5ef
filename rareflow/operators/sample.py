"""Class rebalancing with exact, reproducible sizes.

Sampling is a filter on a keyed hash; the cutoffs come from a histogram of the
hash, so nothing is sorted and no row is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rareflow.functions.hashing import row_fingerprint
from rareflow.operators.ordering import (
    HashOrder, PRINT, SKIP, TOKEN, WEIGHT, expanded, in_pieces)
from rareflow.operators.profile import class_balance
from rareflow.sources.files import with_ordered_shard, with_shard


def rebalanced_positives(negatives: int, percent: float) -> int:
    """Positives that make up ``percent`` of the result; Python rounds half to even."""
    return round(percent * negatives / (100 - percent))


def rebalance(df: DataFrame, target: str, key: Column | str, percent: float = 11,
              seed: str = "rebalance") -> DataFrame:
    """All negatives and as many random positives as give ``percent`` positives."""
    order = HashOrder(df, key, seed, target)
    counts = order.counts()
    wanted = rebalanced_positives(counts.get(0, 0), percent)
    return order.take({0: counts.get(0, 0), 1: wanted})


def sample_n(df: DataFrame, key: Column | str, n: int, seed: str = "sample") -> DataFrame:
    """Exactly n random rows without replacement."""
    return HashOrder(df, key, seed).take(n)


def sample_shares(df: DataFrame, target: str, key: Column | str, n: int,
                  shares: Mapping[int, float], seed: str = "shares") -> DataFrame:
    """Exactly n rows with given class shares; the largest class takes the rounding."""
    sizes = {c: round(n * s / sum(shares.values())) for c, s in shares.items()}
    largest = max(sizes, key=lambda c: (sizes[c], -c))
    sizes[largest] += n - sum(sizes.values())
    return HashOrder(df, key, seed, target).take(sizes)


def sample_balanced(df: DataFrame, target: str, key: Column | str, n: int,
                    seed: str = "balanced") -> DataFrame:
    """Exactly n rows, equally many of each class."""
    return sample_shares(df, target, key, n, {0: 1, 1: 1}, seed)


def oversample(df: DataFrame, target: str, times: int, value: int = 1) -> DataFrame:
    """Every row of one class ``times`` times; the copies stay in their partition."""
    if times < 1:
        raise ValueError("times must be a whole number of at least 1")
    n = F.when(F.col(target) == value, F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def undersample(df: DataFrame, target: str, key: Column | str, ratio: float = 1.0,
                seed: str = "undersample") -> DataFrame:
    """All positives and exactly round(ratio * positives) negatives."""
    order = HashOrder(df, key, seed, target)
    counts = order.counts()
    negatives = min(counts.get(0, 0), round(ratio * counts.get(1, 0)))
    return order.take({0: negatives, 1: counts.get(1, 0)})


def undersample_shards(df: DataFrame, target: str, key: Column | str, num_shards: int,
                       keep: int, seed: str = "undersample") -> DataFrame:
    """All positives and the ``keep`` first negative shards."""
    positive = F.col(target).eqNullSafe(F.lit(1))
    sharded = with_shard(df.filter(~positive), key, num_shards, seed, target)
    return df.filter(positive).withColumn("shard", F.lit(None).cast("int")).unionByName(
        sharded.filter(F.col("shard") < keep))


def cap_classes(df: DataFrame, target: str, key: Column | str, positives: int,
                negatives: int, seed: str = "cap") -> DataFrame:
    """At most so many rows of each class."""
    order = HashOrder(df, key, seed, target)
    counts = order.counts()
    return order.take({0: min(negatives, counts.get(0, 0)), 1: min(positives, counts.get(1, 0))})


def stratified_split(df: DataFrame, target: str, key: Column | str, share: float = 0.8,
                     seed: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) with floor(share * n) rows of each class in train."""
    marked = stratified_mark(df, target, key, share, seed)
    return (marked.filter("in_train = 1").drop("in_train"),
            marked.filter("in_train = 0").drop("in_train"))


def stratified_mark(df: DataFrame, target: str, key: Column | str, share: float = 0.8,
                    seed: str = "split") -> DataFrame:
    """The same split as a column ``in_train``, in one pass over the rows."""
    order = HashOrder(df, key, seed, target)
    return order.mark({c: int(share * n) for c, n in order.counts().items()}, "in_train")


def shuffle_rows(df: DataFrame, key: Column | str, seed: str = "shuffle",
                 partitions: int | None = None) -> DataFrame:
    """Rows in hash order: range-partitioned, sorted within partitions.

    Content breaks ties of the key. If one key holds very many rows, exact copies travel
    as rows with a count, so they spread over partitions; the order is the same.
    """
    order = HashOrder(df, key, seed)
    rows = order.rows.select(*df.columns, TOKEN).withColumn(PRINT, row_fingerprint(df.columns))
    sort, hot = [TOKEN, PRINT], order.is_hot()
    if hot:
        rows = in_pieces(rows.groupBy(*rows.columns).agg(F.count("*").alias(WEIGHT)), WEIGHT)
        sort = [*sort, SKIP]
    spread = rows.repartitionByRange(*([partitions] if partitions else []), *sort) \
        .sortWithinPartitions(*sort).drop(*sort)
    return expanded(spread, WEIGHT) if hot else spread


def drawn_shards(num_shards: int, draws: int, replace: bool = True, seed: str = "draw"
                 ) -> list[int]:
    """Shard ids drawn by hash; with replacement an id may come several times."""

    def number(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    if replace:
        return [number(f"{seed}:{i}") % num_shards for i in range(draws)]
    return sorted(range(num_shards), key=lambda s: (number(f"{seed}:{s}"), s))[:draws]


def thin_positive_shards(df: DataFrame, target: str, key: Column | str, num_shards: int,
                         frac: float = 0.1, upsample: int = 1, replace: bool = True,
                         seed: str = "thin") -> DataFrame:
    """All negatives and int(num_shards * frac) drawn positive shards.

    A shard drawn twice counts twice; every kept positive is further repeated
    ``upsample`` times.
    """
    draws = drawn_shards(num_shards, int(num_shards * frac), replace, f"{seed}:draw")
    times = {s: draws.count(s) * upsample for s in set(draws)}
    negative = F.col(target).eqNullSafe(F.lit(0))
    sharded = with_shard(df.filter(~negative), key, num_shards, seed, target).unionByName(
        df.filter(negative).withColumn("shard", F.lit(None).cast("int")))
    n = F.lit(0)
    for shard, count in times.items():
        n = F.when(F.col("shard") == shard, F.lit(count)).otherwise(n)
    n = F.when(F.col(target) == 0, F.lit(1)).otherwise(n)
    return (sharded.withColumn("__n", n).filter("__n > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n"))


def mixed_batches(df: DataFrame, target: str, key: Column | str, batches: int,
                  seed: str = "mix") -> DataFrame:
    """``batch`` ids that spread each class evenly over the batches."""
    order = HashOrder(df, key, seed, target)
    return order.passed({g: [-(-b * n // batches) for b in range(1, batches)]
                         for g, n in order.counts().items()}, "batch")


def batch_ids(df: DataFrame, key: Column | str, batch_size: int, seed: str = "batch"
              ) -> DataFrame:
    """Fixed-size batches in hash order; ceil(n / batch_size) of them."""
    return HashOrder(df, key, seed).positions("__pos").withColumn(
        "batch", F.floor(F.col("__pos") / batch_size)).drop("__pos")


def sliding_time_split(df: DataFrame, order: Sequence[str], chunks: int = 100, train: int = 20,
                       test: int = 5, step: int = 5) -> DataFrame:
    """Rows with ``window`` and ``part``: chronological chunks of equal size (the last one takes
    the remainder), and windows of ``train`` and then ``test`` chunks every ``step`` chunks.

    A row comes once per window that holds its chunk.
    """
    placed = with_ordered_shard(df, order, chunks).withColumn(
        "__chunk", F.least(F.col("shard"), F.lit(chunks - 1))).drop("shard")
    starts = [w * step for w in range((chunks - train - test) // step + 1)]
    inside = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (
        s <= F.col("__chunk")) & (F.col("__chunk") < s + train + test))
    opened = placed.withColumn("__start", F.explode(inside))
    part = F.when(F.col("__chunk") < F.col("__start") + train, F.lit("train")).otherwise("test")
    return opened.withColumns({"window": (F.col("__start") / step).cast("int"), "part": part}).drop(
        "__start", "__chunk")


def class_percent(df: DataFrame, target: str) -> DataFrame:
    return class_balance(df, target)
