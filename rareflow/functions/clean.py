"""Missing-value rules, text and number casts, tag names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text that a tabular reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
MISSING_CATEGORY = "-1"
MISSING_NUMBER = 0.0


def null_if_nan(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def null_if_token(col: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    return F.when(F.trim(col).isin(*tokens), F.lit(None)).otherwise(col)


def tag_to_column(tag: Column) -> Column:
    """``Dan/Validation_AUROC`` -> ``Validation auroc``."""
    last = F.element_at(F.split(F.lower(tag), "/"), -1)
    words = F.replace(last, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.right(words, F.length(words) - 1))
