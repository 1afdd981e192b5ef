"""Synthetic rows drawn per key, so they do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.functions.hashing import hash_fraction, hash_normal
from rareflow.operators.ordering import HashOrder


def two_gaussians(keys: DataFrame, key: str, positive_prop: float = 0.1, num_features: int = 2,
                  negative_mu: float = 0.0, negative_sigma: float = 1.0,
                  positive_mu: float = 1.0, positive_sigma: float = 0.4,
                  seed: str = "gauss") -> DataFrame:
    """One labelled row per key; exactly round(n * positive_prop) positives."""
    order = HashOrder(keys.select(key), key, f"{seed}:label")
    labelled = order.mark(round(order.total() * positive_prop), "label")
    positive = F.col("label") == 1
    mu = F.when(positive, F.lit(positive_mu)).otherwise(F.lit(negative_mu))
    sigma = F.when(positive, F.lit(positive_sigma)).otherwise(F.lit(negative_sigma))
    draws = [(mu + sigma * hash_normal(key, f"{seed}:x{i}")).alias(f"x{i}")
             for i in range(num_features)]
    return labelled.select(key, *draws, "label")


def mixed_table(keys: DataFrame, key: str, num_continuous: int = 4,
                cardinalities: Sequence[int] = (10, 100, 200, 50),
                seed: str = "mixed") -> DataFrame:
    """Normals, uniform category codes of given cardinalities, a fair 0/1 label."""
    normals = [hash_normal(key, f"{seed}:c{i}").alias(f"c{i}") for i in range(num_continuous)]
    codes = [F.floor(hash_fraction(key, f"{seed}:k{i}") * n).cast("int").alias(f"k{i}")
             for i, n in enumerate(cardinalities)]
    label = F.floor(hash_fraction(key, f"{seed}:label") * 2).cast("int").alias("label")
    return keys.select(key, *normals, *codes, label)


def row_keys(spark: SparkSession, num_samples: int) -> DataFrame:
    """Keys for a wholly synthetic table (tests, model prototypes)."""
    return spark.range(num_samples).select(F.col("id").cast("string").alias("row_key"))
