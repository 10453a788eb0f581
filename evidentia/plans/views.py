"""Audit tables as deterministic views over the driver's tables.

The text of each view is plain SQL that Spark and DuckDB read alike; braces
mark the tables it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_FILE = "CASE WHEN user_id % 17 = 0 THEN '.github/workflows/u' WHEN user_id % 19 = 0 THEN 'pkg/internal-docs/u' WHEN user_id % 11 = 0 THEN 'scripts/u' WHEN user_id % 13 = 0 THEN 'src/x_test.u' ELSE 'src/u' END || CAST(user_id AS STRING) || '.py'"

VIEWS: dict[str, str] = {
    "findings": f"""
SELECT 'F-' || event_type || '-' || lpad(CAST(event_id AS STRING), 8, '0') AS id, 'eng-' || CAST(user_id % 3 AS STRING) AS engagement_id,
  event_type AS tool_origin, {_FILE} AS file_path,
  CAST(minute(ts) AS INT) AS line_start, CAST(minute(ts) + second(ts) % 5 AS INT) AS line_end,
  CASE WHEN event_id % 11 = 0 THEN 'critical' WHEN event_id % 11 < 3 THEN 'high' WHEN event_id % 11 < 6 THEN 'medium' WHEN event_id % 11 < 9 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN event_id % 7 = 0 THEN 'CWE-89' WHEN event_id % 7 = 1 THEN 'CWE-78' WHEN event_id % 7 = 2 THEN 'CWE-22' WHEN event_id % 7 = 3 THEN 'CWE-798' WHEN event_id % 7 = 4 THEN 'CWE-9999' END AS cwe,
  event_type || '.' || CAST(hour(ts) AS STRING) AS rule_id, event_type || ' at ' || CAST(user_id AS STRING) AS title,
  repeat(props || ';', CAST(1 + event_id % 90 AS INT)) AS description,
  CASE WHEN event_id % 5 = 0 THEN 'hypothesis' ELSE 'open' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'confirmed' WHEN event_id % 4 = 1 THEN 'rebutted' WHEN event_id % 4 = 2 THEN 'uncertain' END AS advocate_verdict,
  CASE WHEN event_id % 9 = 0 THEN 'reproduced' WHEN event_id % 9 = 1 THEN 'refuted' WHEN event_id % 9 = 2 THEN 'inconclusive' END AS poc_status,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE 'env-' || CAST(event_id AS STRING) END AS evidence_envelope_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'hash' END AS specifier_hash,
  event_id AS ordinal, ts AS created_at, user_id
FROM {{events}}""",
    "citations": """
SELECT l_orderkey AS finding_id, CASE WHEN l_linenumber % 4 = 0 THEN 'analyzer' WHEN l_linenumber % 4 = 1 THEN 'code' WHEN l_linenumber % 4 = 2 THEN 'hypothesis' ELSE 'poc' END AS citation_type
FROM {lineitem}""",
    "orders_findings": "SELECT o_orderkey AS id, o_orderpriority AS severity FROM {orders}",
    "edges": """
SELECT DISTINCT from_symbol, to_symbol, edge_kind, file_path, line FROM (
  SELECT 'c/load.py:read:cust' || CAST(o_custkey AS STRING) AS from_symbol, 'o/build.py:build:order' || CAST(o_orderkey AS STRING) AS to_symbol, 'assign' AS edge_kind,
    'o/build.py' AS file_path, CAST(o_orderkey % 500 AS INT) AS line FROM {orders}
  UNION ALL SELECT 'o/build.py:build:order' || CAST(l_orderkey AS STRING), 's/call.py:call:supp' || CAST(l_suppkey AS STRING), 'call_arg', 's/call.py', CAST(l_linenumber AS INT) FROM {lineitem}
  UNION ALL SELECT 's/call.py:call:supp' || CAST(s_suppkey AS STRING), 'n/sub.py:nation:n' || CAST(s_nationkey AS STRING), 'subscript', 'n/sub.py', CAST(s_nationkey AS INT) FROM {supplier}
  UNION ALL SELECT 'n/sub.py:nation:n' || CAST(n_nationkey AS STRING), 'r/out.py::' || r_name, 'return', 'r/out.py', CAST(r_regionkey AS INT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
) AS e""",
    "symbols": """
SELECT 'c' || CAST(o_custkey AS STRING) AS file_path, CAST(dayofyear(o_orderdate) AS INT) AS line_start, CAST(dayofyear(o_orderdate) + o_orderkey % 90 AS INT) AS line_end,
  CASE WHEN o_orderkey % 3 = 0 THEN 'function' WHEN o_orderkey % 3 = 1 THEN 'method' ELSE 'class' END AS kind, 'f' || CAST(o_orderkey AS STRING) AS name FROM {orders}""",
    "points": "SELECT event_id, 'c' || CAST(user_id AS STRING) AS file, CAST(event_id % 400 AS INT) AS line FROM {events}",
    "journal": """
SELECT CAST(conv_id AS STRING) AS journal, turn AS ordinal, role, text, entry_hash,
  CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'tampered' ELSE coalesce(lag(entry_hash) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0', 64)) END AS prev_hash
FROM (SELECT conv_id, turn, role, text, HASHED AS entry_hash FROM {conversations}) AS c""",
    "languages": """
SELECT DISTINCT source AS engagement_id, CASE WHEN lang = 'en' THEN 'python' WHEN lang = 'de' THEN 'rust' WHEN lang = 'fr' THEN 'typescript' ELSE 'javascript' END AS language FROM {documents}""",
    "triples": """
SELECT CAST(o_orderkey AS STRING) AS id, 'eng-' || CAST(o_custkey % 3 AS STRING) AS engagement_id, 'Customer-' || CAST(o_custkey AS STRING) AS subject, o_orderstatus AS predicate,
  o_orderpriority AS object, o_totalprice / 100000 AS confidence, o_orderdate AS created_at FROM {orders}""",
}


def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = VIEWS[name].replace("HASHED", "sha2(role || '|' || text, 256)")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(sql)})


def with_views(*names: str) -> str:
    """A WITH clause of views for DuckDB."""
    parts = []
    for n in names:
        sql = re.sub(r"\{(\w+)\}", r"\1", VIEWS[n].replace("HASHED", "sha256(role || '|' || text)"))
        parts.append(f"{n} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts)
