"""From documents to a training mix: five stages, each one operator of ``rareflow.llm``.

A stage takes (spark, docs, sf_dir) and returns documents; its result is written as
Parquet and read again as the next one's input. All but the last keep the columns of
``documents``, further ones of any name included; the last adds the number of each copy.

Null and empty texts pass the filters; rows without an id are never grouped with others.
An empty table passes through. Very long texts are taken whole. Rows with equal ids share the
decisions of a stage; what ties are decided by is said at each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rareflow.llm import decontaminate, lines, minhash, mixing
from rareflow.llm.common import Shelf
from rareflow.llm.toxicity import labelled_texts, without_toxic
from rareflow.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; all stay if the labels taught nothing."""
    return without_toxic(docs, labelled_texts(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go, and documents left empty by that."""
    return lines.dedup_lines(docs, whole=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("source_mix", source_mix)]
ORACLE_SQL = None   # models, alignment and hash orders have no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last = shelf.paths[-1:]
        docs = shelf.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        shelf.forget(last)
    return docs
