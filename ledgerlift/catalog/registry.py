"""Registration of queries with their SQL counterparts, and SQL shared by several of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; `covers` lists inventory ids, `sql` is the equivalent statement."""
    def register(fn):
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def plain(df: DataFrame, *cols) -> DataFrame:
    """Columns with portable types: decimals as doubles, whole numbers as bigint."""
    out = df.select(*cols) if cols else df
    cast = []
    for f in out.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        cast.append((c.cast("double") if t == "decimal" else c.cast("bigint") if t in ("integer", "short", "byte") else c)
                    .alias(f.name))
    return out.select(*cast)


# the derived metering tables and printed corpora, as SQL
LOG = """log AS (
  SELECT event_id AS log_id, CAST(user_id AS VARCHAR) AS api_key,
    'report_' || event_id || CASE event_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' ELSE '.png' END AS file_name,
    CAST(floor(value) AS BIGINT) % 10 + 1 AS pages_billed,
    CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 402 WHEN event_id % 4 = 1 THEN 400
         WHEN event_id % 4 = 2 THEN 413 ELSE 500 END AS status_code,
    CAST(floor(value * 10) AS BIGINT) AS processing_time_ms, ts AS created_at,
    (event_id * 7919) % 20000000 AS file_size_bytes
  FROM events)"""
USERS = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS api_key, c_name AS customer_name,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'prepaid' ELSE 'pay_as_you_go' END AS plan,
    greatest(CAST(floor(c_acctbal / 40) AS BIGINT), 0) AS credits_remaining,
    CAST(c_custkey % 7 AS BIGINT) AS pages_processed_this_month
  FROM customer)"""
LEADS = """leads AS (
  SELECT s_suppkey AS id, s_name AS company_name, 'lead' || s_suppkey || '@example.com' AS email,
    CAST(DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER) AS DATE) AS requested_at,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Approved' ELSE 'Pending' END AS status
  FROM supplier)"""
SHOPS = """shops AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, 'C' || c_custkey AS code,
    translate(n_name, '0123456789', 'ABCDEFGHIJ') AS place
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SALES = SHOPS + """, sales AS (
  SELECT l.*, o_custkey, o_orderdate, p_name, p_retailprice, p_size, s.*, l_linenumber % 3 AS free,
    strftime(o_orderdate, '%d-%m-%Y') AS date
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN shops s ON o_custkey = c_custkey)"""
TOTALS = SHOPS + """, totals AS (
  SELECT s.*, t.total FROM shops s JOIN (
    SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey) t
  ON o_custkey = c_custkey)"""
