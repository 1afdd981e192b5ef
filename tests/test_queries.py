"""Every registered query with a SQL twin equals it on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # NaN equals NaN, and a negative zero equals zero
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else (
        v + 0.0 if isinstance(v, float) else v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple(str(v) for v in r))


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    shares = {(r["step"], r["conversion_target"]): r["percent"] for r in rows}
    assert shares["after", 1] == pytest.approx(11, abs=0.05)
    assert shares["before", 1] > 14
