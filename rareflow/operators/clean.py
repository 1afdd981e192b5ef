"""Cleaning and projection of wide feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rareflow.functions.clean import (
    MISSING_CATEGORY, MISSING_NUMBER, NA_TOKENS, null_if_nan, null_if_token)
from rareflow.operators.profile import cardinality_profile

# Name rules of the continuous feature families.
CONTINUOUS_NAMES = ("id_vintage", "exchange_viewability_rate", "exchange_ctr", "exchange_vcr")
CONTINUOUS_CONTAINS = ("_bpr", "_bpf", "pixel")
CONTINUOUS_SUFFIXES = ("_bpr", "_bpf", "_pixel")
DEFAULT_THRESHOLD = 20


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of the columns of a table; the roles exclude each other."""

    drop: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    onehot: list[str] = field(default_factory=list)
    index: list[str] = field(default_factory=list)
    target: str = "conversion_target"

    @property
    def categorical(self) -> list[str]:
        return self.onehot + self.index

    def roles(self) -> dict[str, str]:
        return {c: role for role in ("drop", "continuous", "onehot", "index")
                for c in getattr(self, role)}


def normalize_missing(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """NaN numbers and missing-value texts become NULL."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = null_if_nan(col)
        elif isinstance(f.dataType, T.StringType):
            col = null_if_token(col, tuple(tokens))
        out.append(col.alias(f.name))
    return df.select(*out)


def continuous_columns(columns: Sequence[str], rule: str = "contains") -> list[str]:
    """Columns of the continuous families, by name part or by suffix."""
    if rule == "contains":
        return [c for c in columns
                if c in CONTINUOUS_NAMES or any(p in c for p in CONTINUOUS_CONTAINS)]
    return [c for c in columns if c in CONTINUOUS_NAMES or c.endswith(CONTINUOUS_SUFFIXES)]


def select_continuous(df: DataFrame, rule: str = "contains") -> DataFrame:
    return df.select(*continuous_columns(df.columns, rule))


def constant_columns(profile: DataFrame) -> list[str]:
    """Columns with at most one distinct value (metadata: one row per column)."""
    return sorted(r["column"] for r in profile.filter("cardinality <= 1").collect())


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    constant = set(constant_columns(cardinality_profile(df, df.columns))) - set(keep)
    return df.drop(*constant)


def assign_roles(profile: DataFrame, categorical: Sequence[str], continuous: Sequence[str],
                 ignored: Sequence[str] = (), target: str = "conversion_target",
                 threshold: int = DEFAULT_THRESHOLD) -> FeatureSpec:
    """Roles from a cardinality profile (metadata: one row per column).

    Constant and ignored columns are dropped; a categorical column is one-hot up
    to ``threshold`` distinct values and index-encoded above. Every column of the
    profile except the target must get exactly one role.
    """
    cardinality = {r["column"]: r["cardinality"] for r in profile.collect()}
    columns = [c for c in cardinality if c != target]
    drop = sorted(c for c in columns if cardinality[c] <= 1 or c in ignored)
    continuous = sorted(set(continuous) - set(drop))
    categorical = set(categorical) - set(drop)
    onehot = sorted(c for c in categorical if cardinality[c] <= threshold)
    index = sorted(categorical - set(onehot))
    given = drop + continuous + onehot + index
    if sorted(given) != sorted(columns):
        extra = set(given) ^ set(columns) | {c for c in given if given.count(c) > 1}
        raise ValueError(f"columns without exactly one role: {sorted(extra)}")
    return FeatureSpec(drop, continuous, onehot, index, target)


def role_table(profile: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(column, cardinality, role) of all features."""
    role = F.lit(None).cast("string")
    for name, value in spec.roles().items():
        role = F.when(F.col("column") == name, F.lit(value)).otherwise(role)
    return (profile.filter(F.col("column") != spec.target)
            .select("column", "cardinality", role.alias("role")))


def with_roles(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Write each column's role into the schema's metadata."""
    for column, role in spec.roles().items():
        if column in df.columns:
            df = df.withMetadata(column, {"role": role})
    return df


def impute(df: DataFrame, categorical: Sequence[str] = (), continuous: Sequence[str] = ()
           ) -> DataFrame:
    """Missing category -> '-1', missing number -> 0; categories become text."""
    as_text = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))
               for c in categorical}
    as_number = {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING_NUMBER))
                 for c in continuous}
    return df.withColumns({**as_text, **as_number})


def cast_category_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def cast_numeric_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Truncate towards zero."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def order_columns(df: DataFrame, target: str) -> DataFrame:
    """Alphabetical columns, target last."""
    return df.select(*sorted(c for c in df.columns if c != target), target)


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def label_pair(y: Column) -> list[Column]:
    """Indicator columns (negative, positive)."""
    return [(y == 0).cast("int").alias("negative"), (y == 1).cast("int").alias("positive")]


def filter_class(df: DataFrame, target: str, value: int) -> DataFrame:
    return df.filter(F.col(target) == value)


def head_of_class(df: DataFrame, target: str, value: int, key: str, n: int = 400) -> DataFrame:
    """The first n rows of a class in key order (top-k, no full sort)."""
    return filter_class(df, target, value).orderBy(key).limit(n)
