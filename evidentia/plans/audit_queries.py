"""Registered queries of the audit operators and their SQL twins.

Each query applies one operator to whole driver tables; see ``views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import crosswalk, dedup, dependencies, graph, intervals, jobs, journal, mutate, patterns, policy, rollups, text, triage, vector
from evidentia.operators.maintained import MaintainedReach
from evidentia.operators.paging import SortedRun
from evidentia.plans.views import view, with_views
from evidentia.sources import files
from evidentia.scratch import Scratch, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
QUIET = " AND ".join(f"NOT file_path ILIKE '{p}'" for p in triage.NOISE)
SHOWN = ", ".join(triage.COMPACT)


def query(sql: str | None = None, *views: str):
    """Register a function under its name, with its SQL over ``views``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (with_views(*views) + "\n" if views else "") + sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- reading findings -------------------------------------------------------------------


@query(f"SELECT {SHOWN} FROM findings WHERE {QUIET} AND {RANK} >= 2 ORDER BY {RANK} DESC, id LIMIT 30", "findings")
def findings_prioritized(spark, d):
    return triage.prioritised(view(spark, d, "findings"), "medium")


@query(f"""SELECT {', '.join(triage.COMPACT[:-1])}, CASE WHEN length(description) > 600 THEN substr(description, 1, 600) || '{S.MARKER}' ELSE description END AS description, tool_origin
FROM findings WHERE tool_origin = 'click' ORDER BY {RANK} DESC, id LIMIT 30 OFFSET 60""", "findings")  # fmt: skip
def findings_page(spark, d):
    return triage.page(triage.listed(triage.of_tool(view(spark, d, "findings"), "click")), triage.by_priority(), 2)


@query(f"SELECT {SHOWN} FROM findings ORDER BY id LIMIT 100 OFFSET 100", "findings")
def findings_compact(spark, d):
    return triage.page(triage.compact(view(spark, d, "findings")), [F.col("id").asc()], 1, 1000)


@query("SELECT id, engagement_id, severity FROM findings WHERE id > 'F-p' ORDER BY id, engagement_id LIMIT 250", "findings")
def pages_by_key(spark, d):
    """Two pages that follow a key, the second from the last key of the first."""
    run = SortedRun(view(spark, d, "findings").select("id", "engagement_id", "severity"), ["id", "engagement_id"], 1000)
    first = run.after(("F-p",), 125)
    last = first.orderBy(F.desc("id"), F.desc("engagement_id"), F.desc(run.tie)).first()
    pages = first if last is None else first.unionByName(run.after(run.cursor(last), 125))
    return pages.drop(run.tie)


@query("SELECT 60 AS first_row, 2 AS page, 30 AS page_size, count(*) AS total, least(30, greatest(0, count(*) - 60)) AS returned, count(*) > 90 AS has_more FROM findings WHERE tool_origin = 'click'", "findings")
def page_envelope(spark, d):
    page = triage.envelope(triage.compact(triage.of_tool(view(spark, d, "findings"), "click")), triage.by_priority(), 2)
    return page.select(F.lit(60).alias("first_row"), "page", "page_size", "total", "returned", "has_more")


@query(f"SELECT id, severity FROM findings WHERE {RANK} >= 3", "findings")
def severity_floor(spark, d):
    return triage.at_least(view(spark, d, "findings"), "high").select("id", "severity")


@query(f"SELECT id, file_path FROM findings WHERE {QUIET}", "findings")
def noise_filter(spark, d):
    return triage.without_noise(view(spark, d, "findings")).select("id", "file_path")


@query("SELECT id, cwe, file_path FROM findings WHERE cwe IN ('CWE-89','CWE-78','CWE-22','CWE-94','CWE-79') AND status = 'open' AND poc_status IS NULL", "findings")
def poc_candidates(spark, d):
    return triage.proof_candidates(view(spark, d, "findings")).select("id", "cwe", "file_path")


@query("SELECT id, tool_origin FROM findings ORDER BY CASE WHEN tool_origin = 'purchase' THEN 0 ELSE 1 END, id LIMIT 100", "findings")
def triage_first(spark, d):
    return triage.page(view(spark, d, "findings").select("id", "tool_origin"), triage.triage_first("purchase"), 0, 100)


@query("SELECT id, title, description, engagement_id, severity, line_end, CAST(NULL AS VARCHAR) AS owasp, CAST(NULL AS VARCHAR) AS decode_error FROM findings WHERE engagement_id = 'eng-1' AND id IN (SELECT min(id) FROM findings WHERE engagement_id = 'eng-1')", "findings")
def finding_detail(spark, d):
    f = view(spark, d, "findings")
    first = f.where("engagement_id = 'eng-1'").agg(F.min("id")).first()[0]
    return triage.detail(f, "eng-1", first).select("id", "title", "description", "engagement_id", "severity", "line_end", "owasp", "decode_error")


@query("SELECT id, subject, engagement_id, created_at FROM triples WHERE subject ILIKE '%customer-1%' ORDER BY created_at DESC, engagement_id, id LIMIT 20", "triples")
def knowledge_recall(spark, d):
    return triage.recall(view(spark, d, "triples"), "customer-1").select("id", "subject", "engagement_id", "created_at")


# --- dedup, windows, sets ----------------------------------------------------------------

DISC = "CASE WHEN line_start = 0 THEN rule_id ELSE coalesce(cwe, rule_id) END"


@query(f"""SELECT id, file_path, line_start, tool_origin FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, line_start, {DISC} ORDER BY tool_origin, ordinal) AS n FROM findings) WHERE n = 1""", "findings")  # fmt: skip
def cross_tool_dedup(spark, d):
    return dedup.cross_tool_dedup(view(spark, d, "findings"), ["tool_origin", "ordinal"]).select("id", "file_path", "line_start", "tool_origin")


@query("SELECT 'F-' || tool_origin || '-' || CASE WHEN length(CAST(ordinal AS VARCHAR)) < 4 THEN lpad(CAST(ordinal AS VARCHAR), 4, '0') ELSE CAST(ordinal AS VARCHAR) END AS id, ordinal FROM findings", "findings")
def minted_ids(spark, d):
    return dedup.with_minted_ids(view(spark, d, "findings").drop("id"), "tool_origin").select("id", "ordinal")


@query("SELECT engagement_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY created_at DESC, id DESC) AS n FROM findings) WHERE n = 1", "findings")
def latest_per_engagement(spark, d):
    return rollups.latest(view(spark, d, "findings"), "engagement_id", "created_at", "id").select("engagement_id", "id", "created_at")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_linenumber <= 2 AND o.l_orderkey = lineitem.l_orderkey AND o.l_suppkey = lineitem.l_suppkey)) GROUP BY ALL")
def edge_insert_ignore(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    new = dedup.new_rows(l.where("l_linenumber > 2"), l.where("l_linenumber <= 2"), ["l_orderkey", "l_suppkey"], ["l_linenumber"])
    return new.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS languages FROM documents GROUP BY source")
def language_sets(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'python' WHEN doc_id % 5 = 1 THEN 'dockerfile' WHEN doc_id % 5 = 2 THEN 'go' END AS language, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark, d):
    n = F.col("doc_id") % 5
    path = F.when(n == 0, "a/b.PY").when(n == 1, "x/Dockerfile").when(n == 2, "m.go").when(n == 3, "Makefile").otherwise(".hidden")
    return table(spark, d, "documents").groupBy(files.language(path).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates --------------------------------------------------------------------------


@query("""SELECT f.id, f.severity, coalesce(list_sort(list(DISTINCT citation_type) FILTER (WHERE citation_type IS NOT NULL)), []) AS citations
FROM orders_findings f LEFT JOIN citations c ON f.id = c.finding_id GROUP BY ALL""", "orders_findings", "citations")  # fmt: skip
def citation_rollup(spark, d):
    return rollups.citation_types(view(spark, d, "orders_findings"), view(spark, d, "citations"))


@query("SELECT o_orderpriority AS severity, citation_type, count(*) AS n FROM orders JOIN citations ON finding_id = o_orderkey GROUP BY ALL", "citations")
def citation_join(spark, d):
    both = view(spark, d, "orders_findings").join(view(spark, d, "citations"), F.col("id") == F.col("finding_id"))
    return both.groupBy("severity", "citation_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT engagement_id, count(*) AS total, count(*) FILTER (advocate_verdict = 'confirmed') AS confirmed, count(*) FILTER (advocate_verdict = 'rebutted') AS rebutted,
count(*) FILTER (advocate_verdict = 'uncertain') AS uncertain, count(*) FILTER (poc_status = 'reproduced') AS reproduced, count(*) FILTER (poc_status = 'refuted') AS refuted FROM findings GROUP BY 1""", "findings")  # fmt: skip
def verdict_summary(spark, d):
    return rollups.verdict_summary(view(spark, d, "findings"))


@query(f"SELECT severity, count(*) AS n, min(id) AS first_id, {RANK} AS severity_rank FROM findings GROUP BY severity", "findings")
def severity_buckets(spark, d):
    return rollups.severity_buckets(view(spark, d, "findings"))


@query("SELECT engagement_id, count(*) AS n FROM findings GROUP BY 1", "findings")
def count_by_engagement(spark, d):
    return rollups.count_by_engagement(view(spark, d, "findings"))


OUTCOME = "CASE WHEN event_type = 'purchase' THEN 'inserted' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'denied' ELSE 'deduped' END"


@query(f"""SELECT CAST(user_id AS VARCHAR) AS engagement_id, count(*) AS total_seen, count(*) FILTER (o = 'inserted') AS inserted, count(*) FILTER (o = 'denied') AS denied,
count(*) FILTER (o = 'deduped') AS deduped, count(*) FILTER (o = 'error') AS error FROM (SELECT user_id, {OUTCOME} AS o FROM events) GROUP BY 1""")  # fmt: skip
def run_counters(spark, d):
    return rollups.run_counters(table(spark, d, "events").select(F.col("user_id").cast("string").alias("engagement_id"), F.expr(OUTCOME).alias("outcome")))


@query("""SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS input_tokens, sum(length(text)) FILTER (role <> 'user') AS output_tokens,
sum(length(text)) FILTER (role = 'user') * 3.0 / 1000000 + sum(length(text)) FILTER (role <> 'user') * 15.0 / 1000000 AS est_cost FROM conversations GROUP BY conv_id""")  # fmt: skip
def cost_rollup(spark, d):
    n, user = F.length("text"), F.col("role") == "user"
    usage = table(spark, d, "conversations").select("conv_id", F.when(user, n).alias("input_tokens"), F.when(~user, n).alias("output_tokens"))
    return rollups.cost_rollup(usage, "conv_id")


@query("""SELECT user_id, event_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS reads_since_store,
sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) >= 6 AS warn
FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)""")  # fmt: skip
def watchdog_runs(spark, d):
    action = F.when(F.col("event_type") == "purchase", "store").when(F.col("event_type").isin("view", "click"), "read")
    steps = table(spark, d, "events").select("user_id", "event_id", "ts", action.alias("action"))
    return rollups.reads_since_store(steps, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "reads_since_store", "warn")


@query("SELECT id, severity, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE severity WHEN 'medium' THEN 'moderate' WHEN 'info' THEN 'unknown' ELSE severity END AS risk FROM findings", "findings")
def sarif_levels(spark, d):
    return view(spark, d, "findings").select("id", "severity", S.sarif_level(F.col("severity")).alias("level"), S.risk_priority(F.col("severity"))["risk"].alias("risk"))


# --- policy and state --------------------------------------------------------------------

CITED = "CASE WHEN ordinal % 5 = 0 THEN 'analyzer' WHEN ordinal % 5 = 1 THEN 'code' WHEN ordinal % 5 = 2 THEN 'poc' END"


def _cited(spark, d):
    c = F.expr(CITED)
    return view(spark, d, "findings").withColumn("citations", F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>")))


@query(f"SELECT id, coalesce({CITED} IN ('analyzer', 'code', 'hypothesis'), false) AND evidence_envelope_id <> '' AND specifier_hash IS NOT NULL AS allowed FROM findings", "findings")
def store_gate(spark, d):
    return policy.store_gate(_cited(spark, d)).select("id", "allowed")


@query(f"""SELECT id, advocate_verdict IS NOT NULL AND advocate_verdict IN ('confirmed', 'uncertain') AND coalesce(poc_status, '') <> 'refuted' AND severity NOT IN ('low', 'info')
AND (coalesce({CITED}, '') = 'analyzer' OR coalesce(poc_status, '') = 'reproduced' OR advocate_verdict = 'confirmed') AS allowed,
(CASE WHEN coalesce(advocate_verdict, '') NOT IN ('confirmed', 'uncertain') THEN 1 ELSE 0 END) + (CASE WHEN coalesce(poc_status, '') = 'refuted' THEN 1 ELSE 0 END) +
(CASE WHEN severity IN ('low', 'info') THEN 1 ELSE 0 END) + (CASE WHEN coalesce({CITED}, '') = 'analyzer' OR coalesce(poc_status, '') = 'reproduced' OR coalesce(advocate_verdict, '') = 'confirmed' THEN 0 ELSE 1 END) AS n_forbids
FROM findings""", "findings")  # fmt: skip
def handoff_gate(spark, d):
    judged = policy.handoff_gate(_cited(spark, d))
    return judged.select("id", "allowed", F.when(F.col("allowed"), 0).otherwise(F.size("reasons")).alias("n_forbids"))


@query("""SELECT event_id, NOT (event_type = 'error' AND (user_id % 6 = 5 OR event_id % 4 = 0)) AS allowed FROM events""")
def rebuttal_gate(spark, d):
    kinds = F.array(*map(F.lit, [*policy.WITNESSES, "hearsay"]))
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "rebutted").otherwise("confirmed").alias("verdict"), F.array(F.get(kinds, F.col("user_id") % 6)).alias("witness_types"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise("because").alias("reason"),
    )
    return policy.rebuttal_gate(rows).select("event_id", "allowed")


ASKED = "CASE WHEN ordinal % 6 = 0 THEN 'reproduced' WHEN ordinal % 6 = 1 THEN 'refuted' WHEN ordinal % 6 = 2 THEN 'inconclusive' WHEN ordinal % 6 = 3 THEN 'nonsense' END"


@query(f"""SELECT id, CASE WHEN done AND s = 'refuted' THEN 'hypothesis' ELSE status END AS status, CASE WHEN done THEN s ELSE poc_status END AS poc_status, e AS mutation_error
FROM (SELECT *, s IS NOT NULL AND e IS NULL AS done FROM (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s = 'nonsense' THEN 'unknown status' WHEN s = 'reproduced' AND user_id % 2 = 1 THEN 'no exhibit' END AS e
FROM (SELECT *, {ASKED} AS s FROM findings)))""", "findings")  # fmt: skip
def poc_status_transition(spark, d):
    f = view(spark, d, "findings")
    asked = f.select("engagement_id", "id", F.expr(ASKED).alias("new_status")).where("new_status IS NOT NULL")
    exhibits = mutate.exhibits(f.where("user_id % 2 = 0").select("engagement_id", F.col("id").alias("finding_id"), F.lit("{}").alias("exhibit")))
    return mutate.set_poc_status(f, asked, exhibits).select("id", "status", "poc_status", "mutation_error")


@query(f"""SELECT id, engagement_id, CASE WHEN s = 'refuted' AND e IS NULL THEN 'hypothesis' ELSE status END AS status, e AS mutation_error FROM (SELECT *, CASE WHEN s = 'refuted' AND bad THEN 'last run was environmental' END AS e
FROM (SELECT id, engagement_id, status, ordinal, CASE WHEN ordinal % 2 = 0 THEN 'refuted' END AS s, ordinal % 5 < 2 AS bad FROM findings
  UNION ALL SELECT id, 'other', status, ordinal, 'refuted', ordinal % 7 < 3 FROM findings))""", "findings")  # fmt: skip
def poc_runs_by_engagement(spark, d):
    """Ids that two engagements share: a run of one says nothing about the other."""
    f = view(spark, d, "findings")
    other = f.withColumn("engagement_id", F.lit("other"))
    both = written(f.unionByName(other), "findings")
    asked = both.where("engagement_id = 'other' OR ordinal % 2 = 0").select("engagement_id", "id", F.lit("refuted").alias("new_status"))
    bad = F.when(F.col("engagement_id") == "other", F.col("ordinal") % 7 < 3).otherwise(F.col("ordinal") % 5 < 2)
    run = lambda at, fails: both.select("engagement_id", F.col("id").alias("finding_id"), F.lit(at).alias("at"), F.lit(False).alias("timed_out"), (~fails).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("exit_code"), F.lit(False).alias("reproduced"))
    none = mutate.exhibits(both.limit(0).select("engagement_id", F.col("id").alias("finding_id"), F.lit("").alias("exhibit")))
    return mutate.set_poc_status(both, asked, none, run(1, ~bad).unionByName(run(2, bad))).select("id", "engagement_id", "status", "mutation_error")


@query("""SELECT 'AC-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(o_custkey % 9000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, f AS finding_id,
CASE WHEN n < m THEN 'AC-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(o_custkey % 9000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(n + 1 AS VARCHAR), 3, '0') END AS next_chain_id
FROM (SELECT l_orderkey AS o_orderkey, o_custkey, CAST(l_suppkey AS VARCHAR) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")  # fmt: skip
def chain_link(spark, d):
    ids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: x["l_suppkey"].cast("string")).alias("finding_ids"))
    chains = ids.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("engagement_id"), (F.col("o_custkey") % 9000).cast("int").alias("chain_no"), F.lit("gate_evasion").alias("stage"), "finding_ids", F.lit("").alias("rationale")
    )
    return mutate.chain_nodes(chains).select("id", "finding_id", "next_chain_id")


@query("SELECT id, subject, least(1.0, greatest(0.0, confidence)) AS confidence FROM triples WHERE trim(object) <> ''", "triples")
def knowledge_write(spark, d):
    return mutate.triples(view(spark, d, "triples")).select("id", "subject", "confidence")


# --- joins: intervals, dimensions, merges ---------------------------------------------------


@query("""SELECT event_id, name, line_start, line_end FROM (SELECT event_id, name, line_start, line_end, row_number() OVER (PARTITION BY event_id ORDER BY line_start DESC, line_end, name) AS n
FROM points JOIN symbols ON file = file_path AND line BETWEEN line_start AND line_end WHERE kind IN ('function', 'method')) WHERE n = 1""", "points", "symbols")  # fmt: skip
def enclosing_span(spark, d):
    return intervals.enclosing_function(view(spark, d, "points"), view(spark, d, "symbols"), ["event_id"])


@query("""SELECT event_id, name, kind, line_start, line_end FROM (SELECT event_id, name, kind, line_start, line_end, row_number() OVER (PARTITION BY event_id ORDER BY line_end - line_start, line_start DESC, name) AS n
FROM points JOIN symbols ON file = file_path AND line BETWEEN line_start AND line_end) WHERE n = 1""", "points", "symbols")  # fmt: skip
def smallest_span(spark, d):
    return intervals.smallest_symbol(view(spark, d, "points"), view(spark, d, "symbols"), ["event_id"])


_JOBS = ", ".join(f"({i}, '{a}', '{b}', '{c}', '{p}')" for i, (a, b, c, p) in enumerate(jobs.JOBS))


@query(f""", jobs(job_ord, language, container, tool, phase) AS (VALUES {_JOBS})
SELECT engagement_id, job_ord, language, container, tool, phase FROM (SELECT *, row_number() OVER (PARTITION BY engagement_id, container, tool ORDER BY job_ord) AS n FROM jobs JOIN languages USING (language)) WHERE n = 1""", "languages")  # fmt: skip
def job_selection(spark, d):
    return jobs.select_jobs(view(spark, d, "languages"))


_CONTROLS = ", ".join(f"('{c}', '{t}', {', '.join(map(str, rest))})" for c, t, *rest in crosswalk.CONTROLS)


@query(f""", controls(cwe, cwe_title, nist_800_53, owasp_asvs, soc2, iso_27001) AS (VALUES {_CONTROLS})
SELECT id, cwe, cwe_title, array_to_string(nist_800_53, ' ') AS nist_800_53, array_to_string(iso_27001, ' ') AS iso_27001, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'moderate' ELSE 'low' END AS priority FROM findings JOIN controls USING (cwe)""", "findings")  # fmt: skip
def crosswalk_map(spark, d):
    return crosswalk.mapped(view(spark, d, "findings")).select("id", "cwe", "cwe_title", F.array_join("nist_800_53", " ").alias("nist_800_53"), F.array_join("iso_27001", " ").alias("iso_27001"), "priority")


@query("SELECT id, CASE WHEN cwe IS NULL THEN 'no cwe' ELSE 'unmapped ' || cwe END AS reason FROM findings WHERE cwe IS NULL OR cwe = 'CWE-9999'", "findings")
def crosswalk_unmapped(spark, d):
    return crosswalk.unmapped(view(spark, d, "findings")).select("id", "reason")


@query("""SELECT coalesce(d.name, l.name) AS name, coalesce(version_spec, '') AS version_spec, version AS resolved_version, coalesce(d.src, 'poetry.lock') AS source_file, CASE WHEN d.name IS NULL THEN 'transitive' ELSE 'direct' END AS kind
FROM (SELECT * FROM (SELECT p_brand || CAST(p_size AS VARCHAR) AS name, '==' || p_type AS version_spec, 'm' || CAST(p_partkey % 3 AS VARCHAR) AS src, row_number() OVER (PARTITION BY p_brand || CAST(p_size AS VARCHAR) ORDER BY p_partkey % 3, p_partkey) AS n FROM part) WHERE n = 1) d
FULL JOIN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) || CAST(s_suppkey % 60 AS VARCHAR) AS name, max(lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) l ON d.name = l.name""")  # fmt: skip
def dependency_merge(spark, d):
    p = table(spark, d, "part")
    declared = p.select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), F.concat(F.lit("=="), "p_type").alias("version_spec"), F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")).alias("source_file"), (F.col("p_partkey") % 3).alias("precedence"), F.col("p_partkey").alias("ordinal"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    locked = s.select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("version"), F.lit("poetry.lock").alias("source_file"))
    return dependencies.merge(declared, locked)


# --- graph -------------------------------------------------------------------------------

SOURCES, SINKS = ["web.cust1", "cust77"], ["db.ASIA", "EUROPE"]
SEED_SQL = "(from_symbol ILIKE '%web.cust1%' OR from_symbol ILIKE '%:cust1')", "(from_symbol ILIKE '%cust77%' OR from_symbol ILIKE '%:cust77')"
SINK_SQL = "(contains(node, 'db.ASIA') OR contains(node, 'ASIA') OR contains(node, 'EUROPE'))"
REACH_SQL = f""", seeds AS (SELECT DISTINCT 'web.cust1' AS source, from_symbol AS seed FROM edges WHERE {SEED_SQL[0]} UNION SELECT DISTINCT 'cust77', from_symbol FROM edges WHERE {SEED_SQL[1]}),
walk AS (SELECT source, seed, to_symbol AS node, 1 AS h FROM seeds JOIN edges ON from_symbol = seed WHERE to_symbol <> seed
  UNION SELECT source, seed, to_symbol, h + 1 FROM walk JOIN edges ON from_symbol = node WHERE NOT {SINK_SQL} AND h < 12 AND to_symbol <> seed)"""


@query(f", a AS (SELECT 1) SELECT DISTINCT 'web.cust1' AS source, from_symbol AS seed FROM edges WHERE {SEED_SQL[0]} UNION SELECT DISTINCT 'cust77', from_symbol FROM edges WHERE {SEED_SQL[1]}", "edges")
def seed_match(spark, d):
    return graph.seeds(view(spark, d, "edges"), SOURCES)


@query("SELECT DISTINCT pattern FROM (SELECT 'db.' || p_name AS pattern FROM part UNION ALL SELECT regexp_extract('db.' || p_name, '([^.:]*)$', 1) FROM part) WHERE pattern <> ''")
def sink_expand(spark, d):
    return graph.expanded(table(spark, d, "part").select(F.concat(F.lit("db."), "p_name").alias("pattern")))


@query(REACH_SQL + " SELECT source, seed, node AS symbol, min(h) AS hops FROM walk GROUP BY ALL", "edges")
def bfs_min_hop(spark, d):
    g = graph.Graph(view(spark, d, "edges"), graph.is_sink(F.col("to_symbol"), SINKS))
    return graph.Reach(g, graph.seeds(g.rows, SOURCES)).rows().select("source", "seed", "symbol", "hops")


@query(REACH_SQL + f" SELECT source, seed, node AS sink, min(h) AS hops FROM walk WHERE {SINK_SQL} GROUP BY ALL", "edges")
def reachable_sinks(spark, d):
    g = graph.Graph(view(spark, d, "edges"), graph.is_sink(F.col("to_symbol"), SINKS))
    paths = graph.Reach(g, graph.seeds(g.rows, SOURCES)).chains()
    return paths.select("source", "seed", "sink", F.size("edges").alias("hops"))


@query(REACH_SQL + f" SELECT source, seed, node AS sink, min(h) AS hops FROM walk WHERE {SINK_SQL} GROUP BY ALL", "edges")
def reach_toward_sinks(spark, d):
    """The sinks alone, by a frontier that drops what cannot lead to one."""
    g = graph.Graph(view(spark, d, "edges"), graph.is_sink(F.col("to_symbol"), SINKS))
    return graph.Reach(g, graph.seeds(g.rows, SOURCES), toward_sinks=True).sinks()


@query(REACH_SQL + f" SELECT source, seed, node AS symbol, min(h) AS hops, {SINK_SQL} AS is_sink FROM walk GROUP BY ALL", "edges")
def reach_in_batches(spark, d):
    """The same reach, kept while the edges come in three batches."""
    kept = MaintainedReach(spark, f"{Scratch(spark, 'maintained').root}/reach", lambda e: graph.seeds(e, SOURCES), lambda s: graph.is_sink(s, SINKS), buckets=8)
    edges = view(spark, d, "edges")
    for batch in range(3):
        kept.insert(edges.where(F.pmod(F.xxhash64("from_symbol", "to_symbol"), F.lit(3)) == batch))
    return kept.rows()


@query(f""", back AS (SELECT DISTINCT to_symbol AS node, 0 AS dist FROM edges WHERE {SINK_SQL.replace('node', 'to_symbol')}
  UNION SELECT from_symbol, dist + 1 FROM back JOIN edges ON to_symbol = node WHERE dist < 12 AND NOT (dist > 0 AND {SINK_SQL}))
SELECT node AS symbol, min(dist) AS dist FROM back GROUP BY ALL""", "edges")
def sink_distance(spark, d):
    g = graph.Graph(view(spark, d, "edges"), graph.is_sink(F.col("to_symbol"), SINKS))
    return g.to_sinks().select("symbol", "dist")


_ASKED = """(SELECT 'eng-' || CAST(n_nationkey % 3 AS VARCHAR) AS engagement_id, unnest([{'p': '%' || lower(substr(n_name, 1, 3)) || '_%', 'k': 'like'}, {'p': 'Brand#' || CAST(n_nationkey AS VARCHAR), 'k': 'contains'},
  {'p': lower(substr(n_name, 2, 2)), 'k': 'contains'}, {'p': '%' || CAST(n_regionkey AS VARCHAR), 'k': 'like'}]) AS a FROM nation)"""


@query(f"""SELECT DISTINCT engagement_id, symbol, a.p AS pattern, a.k AS kind FROM (SELECT 'eng-' || CAST(p_partkey % 3 AS VARCHAR) AS engagement_id, p_name || ':' || p_brand AS symbol FROM part)
JOIN {_ASKED} USING (engagement_id) WHERE CASE a.k WHEN 'like' THEN symbol ILIKE a.p ELSE contains(symbol, a.p) END""")  # fmt: skip
def patterns_by_engagement(spark, d):
    """Each engagement's own patterns against its symbols: long ones, ones of two letters, and ones of one digit."""
    eng = lambda c: F.concat(F.lit("eng-"), (F.col(c) % 3).cast("string")).alias("engagement_id")
    symbols = table(spark, d, "part").select(eng("p_partkey"), F.concat("p_name", F.lit(":"), "p_brand").alias("symbol"))
    one = lambda p, kind: F.struct(p.alias("pattern"), F.lit(kind).alias("kind"))
    forms = F.array(
        one(F.concat(F.lit("%"), F.lower(F.substring("n_name", 1, 3)), F.lit("_%")), "like"), one(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")), "contains"),
        one(F.lower(F.substring("n_name", 2, 2)), "contains"), one(F.concat(F.lit("%"), F.col("n_regionkey").cast("string")), "like"),
    )
    asked = table(spark, d, "nation").select(eng("n_nationkey"), F.explode(forms).alias("f")).select("engagement_id", "f.*")
    return patterns.matches(symbols, asked, ["engagement_id"])


_SINK_OF = "CASE engagement_id WHEN 'eng-0' THEN contains(node, 'EUROPE') ELSE contains(node, 'ASIA') END"


@query(f""", every AS (SELECT * FROM edges, (SELECT unnest(['eng-0', 'eng-1']) AS engagement_id)),
asked AS (SELECT 'eng-' || CAST(n_nationkey % 2 AS VARCHAR) AS engagement_id, 'web.cust' || CAST(n_nationkey AS VARCHAR) AS source, 'cust' || CAST(n_nationkey AS VARCHAR) AS leaf FROM nation),
seeds AS (SELECT DISTINCT engagement_id, source, from_symbol AS seed FROM every JOIN asked USING (engagement_id) WHERE from_symbol ILIKE '%' || source || '%' OR from_symbol ILIKE '%:' || leaf),
walk AS (SELECT s.engagement_id, source, seed, to_symbol AS node, 1 AS h FROM seeds s JOIN every e ON from_symbol = seed AND e.engagement_id = s.engagement_id WHERE to_symbol <> seed
  UNION SELECT w.engagement_id, source, seed, to_symbol, h + 1 FROM walk w JOIN every e ON from_symbol = node AND e.engagement_id = w.engagement_id WHERE NOT {_SINK_OF.replace('engagement_id', 'w.engagement_id')} AND h < 12 AND to_symbol <> seed)
SELECT engagement_id, source, seed, node AS sink, min(h) AS hops FROM walk WHERE {_SINK_OF} GROUP BY ALL""", "edges")  # fmt: skip
def reach_by_engagement(spark, d):
    """Sources and sinks that differ by engagement, in one traversal."""
    by = ["engagement_id"]
    edges = view(spark, d, "edges").select("*", F.explode(F.array(F.lit("eng-0"), F.lit("eng-1"))).alias("engagement_id"))
    n = table(spark, d, "nation")
    sources = n.select(F.concat(F.lit("eng-"), (F.col("n_nationkey") % 2).cast("string")).alias("engagement_id"), F.concat(F.lit("web.cust"), F.col("n_nationkey").cast("string")).alias("pattern"))
    sinks = spark.createDataFrame([("eng-0", "EUROPE"), ("eng-1", "db.ASIA")], "engagement_id string, pattern string")
    held = written(edges, "edges")
    ends = patterns.holding(held.select(*by, F.col("to_symbol").alias("symbol")), sinks, by, leaves=True)
    g = graph.Graph(held, ends, by)
    return graph.Reach(g, patterns.seeds(g.rows, sources, by)).sinks()


def _names_guard(c: str) -> str:
    return f"(contains({c}, 'Authorize') OR contains({c}, 'n7'))"


# The scope of a line of o/build.py: its function of 50 lines and five lines above it; line 0 lies in none.
_SCOPE = """(%s = 'o/build.py' AND EXISTS (SELECT 1 FROM (SELECT unnest([97, 194, 291, 388, 485]) AS g) WHERE g BETWEEN
CASE WHEN %s < 1 THEN 1 ELSE greatest(1, (%s - 1) // 50 * 50 - 4) END AND CASE WHEN %s < 1 THEN 8 ELSE (%s - 1) // 50 * 50 + 50 END))"""


@query(REACH_SQL + f""", nodes AS (SELECT source, seed, node, min(h) AS h FROM walk GROUP BY ALL),
up AS (SELECT n.source, n.seed, n.node, n.h, min({{'a': from_symbol, 'b': line, 'c': edge_kind, 'd': file_path}}) AS p FROM nodes n JOIN edges e ON e.to_symbol = n.node
  LEFT JOIN nodes m ON m.source = n.source AND m.seed = n.seed AND m.node = e.from_symbol WHERE (n.h = 1 AND e.from_symbol = n.seed) OR (m.h = n.h - 1 AND NOT {SINK_SQL.replace('node', 'm.node')}) GROUP BY ALL),
back AS (SELECT source, seed, node AS sink, h AS hops, p AS last_p, p AS first_p, p.a AS at_, {_names_guard('node')} OR {_names_guard('p.a')} AS g FROM up WHERE {SINK_SQL}
  UNION ALL SELECT b.source, b.seed, b.sink, b.hops, b.last_p, u.p, u.p.a, b.g OR {_names_guard('u.p.a')} FROM back b JOIN up u ON u.source = b.source AND u.seed = b.seed AND u.node = b.at_ WHERE b.at_ <> b.seed)
SELECT 'TC-0a1b2c3d-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id, source_file, source_line, sink_file, sink_line, CAST(hops AS INT) AS hop_count,
  NOT (g OR {_SCOPE % ('source_file', *['source_line'] * 4)} OR {_SCOPE % ('sink_file', *['sink_line'] * 4)}) AS unguarded
FROM (SELECT first_p.d AS source_file, first_p.b AS source_line, last_p.d AS sink_file, last_p.b AS sink_line, hops, g, row_number() OVER (ORDER BY seed, sink, hops, source) AS n FROM back WHERE at_ = seed)""", "edges")  # fmt: skip
def taint_chains(spark, d):
    e = view(spark, d, "edges")
    lines = spark.createDataFrame([("o/build.py", n, "checked = Authorize(user)" if n % 97 == 0 else "x = y") for n in range(1, 501)], "file_path string, line int, content string")
    symbols = spark.createDataFrame([("o/build.py", n, n + 49, "function", f"f{n}") for n in range(1, 500, 50)], "file_path string, line_start int, line_end int, kind string, name string")
    return triage.chain_list(graph.taint_chains(e, SOURCES, SINKS, ["Authorize", "n7"], symbols, lines, "0a1b2c3d-e4f5"))


@query("SELECT l_orderkey, count(*) FILTER (contains('s' || CAST(l_suppkey AS VARCHAR), 's7')) > 0 AS guarded FROM lineitem GROUP BY l_orderkey")
def guard_on_path(spark, d):
    hop = F.struct(F.concat(F.lit("o"), F.col("l_partkey").cast("string")).alias("from_symbol"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_symbol"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(hop).alias("edges")).select("l_orderkey", graph.on_path(F.col("edges"), ["s7"]).alias("guarded"))


@query("""SELECT DISTINCT p.file, p.line FROM (SELECT DISTINCT file, line FROM points) p LEFT JOIN (SELECT file, line, line_start, line_end FROM (SELECT file, line, line_start, line_end,
row_number() OVER (PARTITION BY file, line ORDER BY line_start DESC, line_end, name) AS n FROM (SELECT DISTINCT file, line FROM points) JOIN symbols ON file = file_path AND line BETWEEN line_start AND line_end WHERE kind IN ('function', 'method')) WHERE n = 1) s USING (file, line)
JOIN (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS f, CAST(o_orderkey % 300 AS INT) AS l FROM orders WHERE o_orderpriority ILIKE '%urgent%') g ON g.f = p.file AND g.l BETWEEN greatest(1, coalesce(s.line_start - 5, p.line - 40)) AND coalesce(s.line_end, p.line + 8)""", "points", "symbols")  # fmt: skip
def guard_in_scope(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_path"), (F.col("o_orderkey") % 300).cast("int").alias("line"), F.upper("o_orderpriority").alias("content"))
    return graph.guarded_scopes(view(spark, d, "points"), view(spark, d, "symbols"), lines, ["URGENT"])


@query("""SELECT id, file_path AS sink_file, line_start AS hop_count, severity IN ('critical', 'info') AS unguarded FROM findings
ORDER BY CASE WHEN severity IN ('critical', 'info') THEN 0 ELSE 1 END, CASE WHEN """ + " OR ".join(f"file_path ILIKE '{p}'" for p in triage.TOOLING) + """ THEN 1 ELSE 0 END, id LIMIT 100""", "findings")  # fmt: skip
def taint_tier_order(spark, d):
    f = view(spark, d, "findings").select("id", F.col("file_path").alias("sink_file"), F.col("line_start").alias("hop_count"), F.when(F.col("severity").isin("critical", "info"), F.array(F.lit("unguarded"))).otherwise(F.array().cast("array<string>")).alias("sanitizers_seen"))
    return triage.page(f, triage.by_tier(), 0, 100).select("id", "sink_file", "hop_count", F.array_contains("sanitizers_seen", "unguarded").alias("unguarded"))


# --- text, vectors, journal ----------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '{S.MARKER}' ELSE text END AS text FROM documents")
def text_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", S.cut_chars(F.col("text"), 600).alias("text"))


@query("""SELECT doc_id, decode(unhex(regexp_extract(hex(encode(text))[1 : 2 * 4096], '^((?:[0-7].|C.[89AB].|D.[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)*)', 1))) AS text FROM documents""")
def byte_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", S.cut_bytes(F.col("text"), 4096).alias("text"))


@query("""SELECT doc_id, coalesce((SELECT string_agg(CAST(i AS VARCHAR) || ': ' || l[i], chr(10) ORDER BY i) FROM (SELECT unnest(range(2, 5)) AS i) WHERE i <= len(l)), '') AS lines
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)""")  # fmt: skip
def context_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_range(F.col("text"), 2, 4).alias("lines"))


@query("""SELECT doc_id, array_to_string([trim(x, ' ') FOR x IN string_split(regexp_replace(text, '\\n$', ''), chr(10)) IF starts_with(ltrim(x, ' '), 'The ') OR starts_with(ltrim(x, ' '), 'De ')], chr(10)) AS imports FROM documents""")
def import_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.import_lines(F.col("text"), ("The ", "De ")), "\n").alias("imports"))


@query("SELECT doc_id, 'S-' || lang || '-' || source || '-' || substr(sha256(text), 1, 12) AS envelope_id FROM documents")
def envelope_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", S.envelope_id(F.concat(F.lit("S-"), "lang"), F.col("source"), F.encode("text", "UTF-8")).alias("envelope_id"))


_DIST = "list_sum([(a - b) * (a - b) FOR a, b IN q])"


@query("SELECT e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2 AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY 2, 1 LIMIT 5")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0].embedding
    return vector.nearest(e, q, 5, vector="embedding", key="vec_id").select("vec_id", "distance")


@query("SELECT e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2 AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE label = 3 ORDER BY 2, 1 LIMIT 5")
def knn_filtered(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0].embedding
    return vector.nearest(e, q, 5, F.col("label") == 3, "embedding", "vec_id").select("vec_id", "distance")


@query("""SELECT query_id, n - 1 AS rank, vec_id, distance FROM (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) ** 2 AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS n FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE n <= 5""")  # fmt: skip
def knn_each(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    return vector.nearest_each(e, queries, 5, 64, "embedding", "vec_id")


@query("SELECT journal, ordinal, prev_hash = coalesce(lag(entry_hash) OVER (PARTITION BY journal ORDER BY ordinal), repeat('0', 64)) AS link_ok FROM journal", "journal")
def journal_links(spark, d):
    return journal.links(view(spark, d, "journal"), body=F.col("text")).select("journal", "ordinal", "link_ok")
