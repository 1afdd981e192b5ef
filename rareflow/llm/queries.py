"""The training-data operators as registered queries over the test tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from rareflow.llm import oracles
from rareflow.llm.collocations import Collocations
from rareflow.llm.decontaminate import Decontamination
from rareflow.llm.licences import LicenceScan
from rareflow.llm.lines import LineDedup
from rareflow.llm.minhash import NearDuplicates
from rareflow.llm.mixing import Mix
from rareflow.llm.nearest import NearestNeighbours
from rareflow.llm.personal import PersonalData
from rareflow.llm.runs import PeriodicRuns
from rareflow.llm.simhash import SimHashDuplicates
from rareflow.llm.suffixes import RepeatedPassages
from rareflow.llm.toxicity import ToxicityClassifier, fold_of, labelled_texts
from rareflow.llm.urls import judge_urls
from rareflow.plans.registry import Query
from rareflow.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op1_minhash_near_duplicates", oracles.NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates().groups(table(spark, sf_dir, "documents"))


@query("op2_license_scan", oracles.license_scan())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LicenceScan().scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op3_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return PersonalData().mark(docs).drop("text")


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = ToxicityClassifier()
    model = classifier.fit(labelled_texts(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of("doc_id") == 2, F.lit(False)).alias("held_out")
    return classifier.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op5_source_mix", oracles.source_mix())
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return Mix().copies(docs, texts=False).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_repeated_passages", oracles.REPEATED_PASSAGES)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RepeatedPassages().spans(table(spark, sf_dir, "documents"))


@query("op7_url_filter", oracles.URL_FILTER)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")], "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op8_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearestNeighbours().search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op9_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return LineDedup(whole=True).clean(docs).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op10_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = Decontamination().mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query("op11_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHashDuplicates().groups(table(spark, sf_dir, "documents"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of every tenth text, by a hash of its id, go round from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op12_periodic_runs", oracles.PERIODIC_RUNS)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PeriodicRuns().find(table(spark, sf_dir, "documents"), rewrite=looped)
    told = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[name].cast("string") for name in ("start", "length", "period")]),
        F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_phrase_collocations", oracles.COLLOCATIONS)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collocations().find(table(spark, sf_dir, "documents"))
