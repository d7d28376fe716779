"""Trees and sequences over the provided tables: one row per node, (tree_id, u, parent, label[, ts]); parent -1 is the root.

The SQL runs in Spark and in DuckDB alike; in Spark the tables are given as {name}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_TREE = """
SELECT tree_id, u, CAST(CASE WHEN u = 0 THEN -1 ELSE greatest(0, u - 1 - event_id % 4) END AS INT) AS parent, label, ts
FROM (SELECT user_id AS tree_id, event_id, event_type AS label, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS u FROM {events})
"""
EVENT_TOKENS = """
SELECT tree_id, u, token FROM (
  SELECT tree_id, u, event_type AS token FROM (SELECT user_id AS tree_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS u FROM {events})
  UNION ALL
  SELECT tree_id, u, concat('v', CAST(CAST(floor(value / 10) AS INT) AS VARCHAR(12))) AS token FROM (SELECT user_id AS tree_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS u FROM {events}))
"""
TRADE_TREE = """
WITH x AS (
  SELECT c_custkey AS tree_id, 0 AS lvl, CAST(-1 AS BIGINT) AS okey, 0 AS lno, TIMESTAMP '1900-01-01 00:00:00' AS ts, c_mktsegment AS label FROM {customer}
  UNION ALL SELECT o_custkey, 1, o_orderkey, 0, o_orderdate, o_orderpriority FROM {orders}
  UNION ALL SELECT o_custkey, 2, l_orderkey, l_linenumber, l_shipdate, concat(l_returnflag, l_linestatus) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey),
n AS (SELECT x.*, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY lvl, ts, okey, lno, label) - 1 AS INT) AS u FROM x WHERE tree_id IN (SELECT c_custkey FROM {customer}))
SELECT c.tree_id, c.u, CAST(CASE c.lvl WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE p.u END AS INT) AS parent, c.label, c.ts
FROM n c LEFT JOIN n p ON c.lvl = 2 AND p.lvl = 1 AND p.tree_id = c.tree_id AND p.okey = c.okey
"""
CONV_CHAIN = """
SELECT conv_id AS tree_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS u,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS INT) AS parent, role AS label FROM {conversations}
"""
URL_TREE = """
WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
                  split_part(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/', 2) AS a,
                  split_part(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/', 3) AS b FROM {pages}),
x AS (SELECT host, 0 AS lvl, '' AS a, '' AS b, host AS label FROM p UNION SELECT host, 1, a, '', a FROM p WHERE a <> ''
      UNION SELECT host, 2, a, b, b FROM p WHERE a <> '' AND b <> ''),
n AS (SELECT x.*, CAST(row_number() OVER (PARTITION BY host ORDER BY lvl, a, b) - 1 AS INT) AS u FROM x)
SELECT c.host AS tree_id, c.u, CAST(CASE c.lvl WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE p.u END AS INT) AS parent, c.label
FROM n c LEFT JOIN n p ON c.lvl = 2 AND p.lvl = 1 AND p.host = c.host AND p.a = c.a
"""
VIEWS = {"event_tree": EVENT_TREE, "event_tokens": EVENT_TOKENS, "trade_tree": TRADE_TREE, "conv_chain": CONV_CHAIN, "url_tree": URL_TREE}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL whose {name}s are tables of ``sf_dir``, views of this module, or ``frames``."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if f"{{{v}}}" in text}
    return spark.sql(text, **(used | frames))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, VIEWS[name])


def duckdb_sql(text: str) -> str:
    """The same SQL for DuckDB, where the tables are there by name and views become subqueries."""
    for name, body in VIEWS.items():
        text = text.replace(f"{{{name}}}", f"({body.strip()})")
    for name in TABLES:
        text = text.replace(f"{{{name}}}", name)
    return text
