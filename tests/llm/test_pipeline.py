"""Registered queries against SQL, and the pipeline stage by stage, on the smallest tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rareflow.llm import lines, minhash, mixing
from rareflow.llm.queries import QUERIES, SQL
from rareflow.llm.toxicity import ToxicityClassifier, labelled_texts, without_toxic

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, found.fetchall()))


def test_stages(spark):
    """Each stage keeps what its rule keeps of its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (9_000_001, "", "en", None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF_DIR)
        if name != "source_mix":
            assert docs.columns == before.columns
        docs = docs.cache()
        assert 0 < docs.count() <= 3 * before.count()
        ids = {r["doc_id"] for r in docs.collect()}
        assert None in ids or name == "source_mix"
        if name == "line_dedup":
            again = lines.LineDedup().clean(before).where("n_removed = 0").collect()
            assert {r["doc_id"] for r in again} <= ids
        if name == "near_dedup":
            left = minhash.NearDuplicates().groups(docs)
            assert left.where("not kept").count() == 0
        if name == "decontamination":
            items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("text").collect()
            texts = [r["text"] or "" for r in docs.collect()]
            assert not any(i["text"] in t for i in items for t in texts)
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []


CLASHING = ["id", "copy", "gone", "n_lines", "n_removed", "hits", "score", "predicted", "size",
            "source_size", "target", "copies", "rep", "kept", "component_id", "Label", "tag", "a", "b"]


def test_extra_columns_stay(spark):
    """Columns named like those of the operators come back with their own values."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, SF_DIR).cache()
        added = ["copy_"] if name == "source_mix" else []
        assert docs.columns == before + added
        rows = docs.select("doc_id", *CLASHING).collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHING)


def test_operators_take_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source")
    plain = lines.LineDedup(whole=True).clean(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed").collect()
    extra = docs.withColumns({c: F.lit("x") for c in CLASHING})
    out = lines.LineDedup(whole=True).clean(extra)
    assert out.columns.count("n_lines") == 1 and {"id", "copy", "gone"} <= set(out.columns)
    assert sorted(out.select("doc_id", "n_lines", "n_removed").collect()) == sorted(plain)
    sizes = mixing.Mix().copies(extra)
    assert sizes.where("copy = 'x'").count() == docs.count()
    assert sizes.schema["size"].dataType.typeName() == "long"


def test_unlearned_toxicity_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"clean text number {i}") for i in range(6)],
                                 "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1)], [(1, 0), (2, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert without_toxic(docs, labelled_texts(docs, table, held_out=9)).count() == 6


def test_sample_is_bounded_when_ids_repeat(spark):
    rows = [(i % 3, f"word{i % 7} other{i % 5} more", i % 2) for i in range(600)]
    labelled = spark.createDataFrame(rows, "id long, text string, label long")
    sample = ToxicityClassifier(sample_rows=50)._sample(labelled, {"word1": 0, "other2": 1})
    assert sample.count() == 50
