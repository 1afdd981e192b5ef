"""Probability helpers shared by models, metrics and streams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLIP = 1e-15


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Second component of the two-way softmax."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit0 - logit1))


def predicted_class(p: Column, threshold: float = 0.5) -> Column:
    """1 where p >= threshold (inclusive), else 0."""
    return F.when(p >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def clipped(p: Column, eps: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss_term(y: Column, p: Column, eps: float = CLIP) -> Column:
    """-log of the probability given to the true class."""
    q = clipped(p, eps)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q))


def binary_entropy(p: Column, eps: float = CLIP) -> Column:
    q = clipped(p, eps)
    return -(q * F.log(q) + (F.lit(1.0) - q) * F.log(F.lit(1.0) - q))
