"""All registered queries and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.operators import clean, encode, profile, sample
from rareflow.plans import (  # noqa: F401
    cleaning, encoding, evaluation, logs, modelling, profiling, sampling, sources, streams)
from rareflow.plans.registry import QUERIES, SQL
from rareflow.session import materialize
from rareflow.sources.files import with_split
from rareflow.sources.tables import (
    CONTINUOUS, IGNORED, KEY, ONEHOT_AND_INDEX, TARGET, impressions)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, clean, profile, encode, rebalance: class balance before and after."""
    raw = materialize(with_split(clean.normalize_missing(impressions(spark, sf_dir)), KEY),
                      "impressions")
    features = raw.drop(KEY, "split")
    roles = clean.assign_roles(profile.cardinality_profile(features, features.columns),
                               ONEHOT_AND_INDEX, CONTINUOUS, IGNORED, TARGET)
    model = encode.FeatureEncoder(roles, "split = 'train'", keep=[KEY]).fit(raw)
    encoded = materialize(model.transform(raw), "encoded")
    before = profile.class_balance(encoded, TARGET).withColumn("step", F.lit("before"))
    after = profile.class_balance(sample.rebalance(encoded, TARGET, KEY, 11), TARGET)
    return before.unionByName(after.withColumn("step", F.lit("after")))


__all__ = ["QUERIES", "SQL", "flagship"]
