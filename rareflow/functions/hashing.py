"""Keyed hash order: every random choice is ``md5(seed || ':' || row_key)``.

The order depends only on the seed and the row, not on partitioning, retries or
the number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_token(key: Column | str, seed: str) -> Column:
    """Hex text whose order is the pseudo-random order of the rows."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_fraction(key: Column | str, seed: str, digits: int = 8) -> Column:
    """Uniform number in [0, 1) from the first ``digits`` hex digits of the token."""
    text = F.substring(hash_token(key, seed), 1, digits)
    return F.conv(text, 16, 10).cast("double") / F.lit(float(16**digits))


def hash_normal(key: Column | str, seed: str) -> Column:
    """Standard normal number (Box-Muller) from two hash fractions."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_fraction(key, f"{seed}:r")))
    return radius * F.cos(F.lit(2.0 * 3.141592653589793) * hash_fraction(key, f"{seed}:a"))


def row_fingerprint(columns: list[str]) -> Column:
    """Hash of a whole row; null-safe. Orders rows that share a key."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
