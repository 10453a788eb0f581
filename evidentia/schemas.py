"""Schemas of the evidence tables; tables are Parquet, partitioned by engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of every stored table, as DDL. Nested facts that a row store keeps as
#: JSON text are native arrays and structs here.
TABLES: dict[str, str] = {
    "engagements": "id string, client string, scope_hash string, start_date date, end_date date, status string, roa_hash string, created_at timestamp",
    "findings": (
        "id string, engagement_id string, phase string, severity string, confidence string, cwe string, owasp string, file_path string, "
        "line_start int, line_end int, title string, description string, reachable boolean, exploitable boolean, evidence_envelope_id string, "
        "status string, rank_score double, specifier_hash string, advocate_verdict string, tool_origin string, poc_status string, created_at timestamp"
    ),
    "tool_runs": (
        "id string, engagement_id string, tool string, args_json string, started_at timestamp, duration_ms long, exit_code int, envelope_id string, "
        "cedar_decision string"
    ),
    "knowledge": "id string, engagement_id string, subject string, predicate string, object string, confidence double, created_at timestamp",
    "evidence": "envelope_id string, sha256 string, path string, content_type string, created_at timestamp",
    "repo_facts": "engagement_id string, kind string, json string",
    "symbol_index": "engagement_id string, file_path string, line_start int, line_end int, kind string, name string, language string",
    "routes": "engagement_id string, method string, path string, handler_symbol string, middleware string, auth_required boolean, roles string",
    "dataflow_edges": "engagement_id string, from_symbol string, to_symbol string, edge_kind string, file_path string, line int",
    "secrets": "engagement_id string, file_path string, line int, kind string, classification string, git_age_days int, packaged boolean",
    "sboms": "engagement_id string, format string, path string, envelope_id string",
    "threat_models": "specifier_hash string, engagement_id string, json string, signed_at timestamp, signature string",
    "finding_citations": (
        "engagement_id string, finding_id string, citation_type string, analyzer_finding string, code_path string, code_line_start int, "
        "code_line_end int, hypothesis_id string, intended_poc string"
    ),
    "hypotheses": "id string, engagement_id string, description string, status string, created_by_agent string, created_at timestamp",
    "taint_chains": (
        "id string, engagement_id string, source_file string, source_line int, sink_file string, sink_line int, "
        "chain array<struct<file_path:string,line:int,propagation_reason:string>>, sanitizers_seen array<string>, created_at timestamp"
    ),
    "attack_chains": "id string, engagement_id string, stage string, finding_id string, evidence_id string, next_chain_id string, rationale string, created_at timestamp",
    "knowledge_triples": (
        "id string, engagement_id string, subject string, predicate string, object string, confidence double, rationale string, source_phase string, "
        "created_at timestamp"
    ),
}

#: Insert-or-ignore keys of tables that have one.
KEYS: dict[str, list[str]] = {
    "engagements": ["id"], "findings": ["engagement_id", "id"], "evidence": ["envelope_id"],
    "dataflow_edges": ["engagement_id", "from_symbol", "to_symbol", "line"], "threat_models": ["specifier_hash"],
    "hypotheses": ["engagement_id", "id"], "taint_chains": ["engagement_id", "id"], "attack_chains": ["engagement_id", "id"],
    "knowledge_triples": ["engagement_id", "id"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
