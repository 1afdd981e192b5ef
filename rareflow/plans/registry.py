"""Name -> Spark query and, where SQL can say it, the equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    doubles = [c for c in columns if kinds[c] == "double"]
    df = df.withColumns({f"__near_{c}": F.rint(F.col(c) * F.lit(10.0 ** digits)) for c in doubles})
    return df.withColumns({c: _quick_r(c, digits) if c in doubles else r(c, digits)
                           for c in columns}).drop(*[f"__near_{c}" for c in doubles])


def _quick_r(column: str, digits: int) -> Column:
    """``r`` of a double. Rounding by decimals is slow, and only near a tie, or beyond the digits of
    a double, can it differ from rounding the shifted number."""
    x, near, scale = F.col(column), F.col(f"__near_{column}"), F.lit(10.0 ** digits)
    same = (F.abs(x * scale - near) < 0.499) & (F.abs(near) < 1e12)
    return F.when(same, near / scale).otherwise(F.round(x, digits)) + F.lit(0.0)


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


# -- SQL forms of the inputs in sources/tables.py ------------------------------

LINES = """lines AS (SELECT md5(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_key, l_orderkey, l_returnflag,
  l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_partkey AS VARCHAR) AS l_partkey, l_quantity,
  l_extendedprice, nullif(l_tax, CAST(0 AS DOUBLE)) AS l_tax,
  CAST(1 AS DOUBLE) AS column_weights,
  CAST(l_discount >= CAST('0.085' AS DOUBLE) AS INTEGER) AS conversion_target FROM lineitem)"""
IMPRESSIONS = LINES + """, impressions AS (SELECT row_key, l_returnflag, l_linestatus,
  l_linenumber, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
  c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, l_suppkey, l_partkey, l_quantity,
  l_extendedprice, o_totalprice, c_acctbal, l_tax, column_weights, conversion_target
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
SPLIT = """split_lines AS (SELECT *, CASE WHEN substr(md5('split:' || row_key), 1, 2) <= 'cc'
  THEN 'train' WHEN substr(md5('split:' || row_key), 1, 2) <= 'e5' THEN 'validation'
  ELSE 'test' END AS split FROM lines)"""
SCORES = LINES + """, scores AS (SELECT row_key, conversion_target AS y,
  CASE WHEN conversion_target = 1 THEN least(base + CAST('0.1' AS DOUBLE), CAST(1 AS DOUBLE))
  ELSE base END AS score FROM (SELECT row_key, conversion_target,
    CAST(('0x' || substr(md5('score:' || row_key), 1, 4)) AS INTEGER) / CAST(65536 AS DOUBLE)
    AS base FROM lines))"""
VECTORS = """vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features,
  CAST(label = 0 AS INTEGER) AS conversion_target FROM embeddings)"""
CELLS = VECTORS + """, cells AS (SELECT vec_id, conversion_target, CAST(pos AS INTEGER) - 1 AS pos,
  features[pos] AS value FROM vectors, generate_series(1, 64) AS g(pos)
  WHERE pos <= len(features))"""
LOG = """metric_log AS (SELECT user_id % 3 AS run,
  date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS step,
  event_type AS tag, avg(value) AS value FROM events GROUP BY 1, 2, 3)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def fraction_sql(text: str, digits: int = 8) -> str:
    """SQL form of functions.hashing.hash_fraction."""
    return (f"(CAST(('0x' || substr(md5({text}), 1, {digits})) AS BIGINT)"
            f" / CAST({16 ** digits} AS DOUBLE))")


def normal_sql(key: str, seed: str) -> str:
    radius = f"sqrt(-2 * ln(1 - {fraction_sql(f"'{seed}:r:' || {key}")}))"
    return f"({radius} * cos(2 * 3.141592653589793::DOUBLE * {fraction_sql(f"'{seed}:a:' || {key}")}))"
