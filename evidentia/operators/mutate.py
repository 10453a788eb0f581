"""Copy-on-write mutations: every one maps a table to its next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.scalars import clamp, eng8
from evidentia.operators.rollups import latest

# States that are accepted, stages of a chain.
POC_INPUTS = ["reproduced", "refuted", "inconclusive", "reproduced_by_citation"]
VERDICTS = ["confirmed", "rebutted", "uncertain"]
STAGES = [
    "surface_mapping", "tool_subversion", "instruction_injection", "reasoning_capture", "gate_evasion", "privileged_action", "audit_evasion",
]


def last_of(requests: DataFrame, value: str, order: list[str] | None = None) -> DataFrame:
    """One request a finding (engagement_id, id): the last in ``order``, by default by
    column ``at`` where there is one; of equal ones the largest value."""
    order = order if order is not None else [c for c in ("at",) if c in requests.columns]
    return requests.groupBy("engagement_id", "id").agg(F.max_by(F.col(value), F.struct(*order, value)).alias(value))


def set_verdicts(findings: DataFrame, verdicts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """New verdicts by (engagement_id, id); findings without one stay as they are, and
    of several for one finding the last counts (see :func:`last_of`)."""
    new = last_of(verdicts, "verdict", order).select("engagement_id", "id", F.col("verdict").alias("_v"))
    return findings.join(new, ["engagement_id", "id"], "left").withColumn("advocate_verdict", F.coalesce("_v", "advocate_verdict")).drop("_v").select(*findings.columns)


def is_environmental(timed_out: Column, ok: Column, error: Column, exit_code: Column, reproduced: Column) -> Column:
    """A run that failed because of its surroundings says nothing about the finding."""
    no = lambda c, d: F.coalesce(c, F.lit(d))
    return no(timed_out, False) | ~no(ok, False) | error.isNotNull() | ((no(exit_code, 0) != 0) & ~no(reproduced, False))


def set_poc_status(findings: DataFrame, requests: DataFrame, citations: DataFrame, runs: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Apply requested proof states; ``mutation_error`` says why one was refused.

    ``requests`` has engagement_id, id and new_status; of several for one finding
    the last counts (see :func:`last_of`). States that begin with ``reproduced``
    need an exhibit, a citation of type ``poc`` of the same engagement. ``refuted`` makes
    the finding a hypothesis, and is refused if the last run of the finding
    (``runs``: engagement_id, finding_id, at, timed_out, ok, error, exit_code,
    reproduced) was environmental. A run speaks for its own engagement alone;
    ``runs`` of one engagement, that of ``findings``, may leave the column out."""
    exhibits = citations.where("citation_type = 'poc'").select(F.col("engagement_id").alias("_xe"), F.col("finding_id").alias("_x")).distinct()
    asked = last_of(requests, "new_status", order)
    both = findings.join(asked, ["engagement_id", "id"], "left").join(exhibits, (F.col("id") == F.col("_x")) & (F.col("engagement_id") == F.col("_xe")), "left")
    if runs is None:
        both = both.withColumn("_env", F.lit(False))
    else:
        key = [c for c in ("engagement_id", "finding_id") if c in runs.columns]
        last = latest(runs, key, "at", "ok").withColumn(
            "_env", is_environmental(F.col("timed_out"), F.col("ok"), F.col("error"), F.col("exit_code"), F.col("reproduced"))
        )
        last = last.select("_env", F.col("finding_id").alias("_f"), *([F.col("engagement_id").alias("_fe")] if len(key) > 1 else []))
        same = (F.col("id") == F.col("_f")) & (F.col("engagement_id") == F.col("_fe") if len(key) > 1 else F.lit(True))
        both = both.join(last, same, "left").drop("_f", "_fe")
    s = F.col("new_status")
    error = (
        F.when(s.isNull(), None).when(~s.isin(POC_INPUTS), "unknown status").when(s.startswith("reproduced") & F.col("_x").isNull(), "no exhibit")
        .when((s == "refuted") & F.coalesce("_env", F.lit(False)), "last run was environmental")
    )
    done = s.isNotNull() & error.isNull()
    out = both.withColumn("mutation_error", error).withColumn("status", F.when(done & (s == "refuted"), "hypothesis").otherwise(F.col("status")))
    return out.withColumn("poc_status", F.when(done, s).otherwise(F.col("poc_status"))).select(*findings.columns, "mutation_error")


CITATION = "engagement_id string, finding_id string, citation_type string, analyzer_finding string, code_path string, code_line_start int, code_line_end int, hypothesis_id string, intended_poc string"


def citation_rows(citations: DataFrame) -> DataFrame:
    """Citations as rows of finding_citations: of a citation only the columns of its type
    are kept, the others are null. Citations of an unknown type give none."""
    own = {"analyzer_finding": "analyzer", "code_path": "code", "code_line_start": "code", "code_line_end": "code", "hypothesis_id": "hypothesis", "intended_poc": "hypothesis"}
    kinds = dict(c.split() for c in CITATION.split(", "))
    have = set(citations.columns)
    known = citations.where(F.col("citation_type").isin("analyzer", "code", "hypothesis"))
    return known.select(
        "engagement_id", "finding_id", "citation_type",
        *(F.when(F.col("citation_type") == kind, F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c, kind in own.items()),
    )


def exhibits(artifacts: DataFrame) -> DataFrame:
    """Proof artefacts (engagement_id, finding_id, exhibit) as citations of type ``poc``,
    to be appended to finding_citations."""
    kinds = dict(c.split() for c in CITATION.split(", "))
    given = {"engagement_id": F.col("engagement_id"), "finding_id": F.col("finding_id"), "citation_type": F.lit("poc"), "intended_poc": F.col("exhibit")}
    return artifacts.select(*(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def chain_nodes(chains: DataFrame) -> DataFrame:
    """Nodes of attack chains: one for each finding in order, linked to the next.

    ``chains`` has engagement_id, chain_no, stage, finding_ids, rationale. Ids are
    AC-<eng8>-cccc-nnn; chains of an unknown stage or without findings give none."""
    rows = chains.where(F.col("stage").isin(STAGES)).select("*", F.posexplode("finding_ids").alias("_at", "finding_id"))
    name = lambda at: F.concat(F.lit("AC-"), eng8(F.col("engagement_id")), F.format_string("-%04d-%03d", "chain_no", at))
    last = F.col("_at") + 1 >= F.size("finding_ids")
    return rows.select(
        name(F.col("_at") + 1).alias("id"), "engagement_id", "stage", "finding_id", F.lit(None).cast("string").alias("evidence_id"),
        F.when(~last, name(F.col("_at") + 2)).alias("next_chain_id"),
        F.coalesce(F.nullif(F.trim("rationale"), F.lit("")), F.concat(F.lit("step "), (F.col("_at") + 1).cast("string"))).alias("rationale"),
    )


def linked(nodes: DataFrame, by: list[str], order: list[str], node_id: str = "id") -> DataFrame:
    """``next_chain_id`` by order, for nodes that come one by one."""
    return nodes.withColumn("next_chain_id", F.lead(node_id).over(Window.partitionBy(*by).orderBy(*order)))


def triples(rows: DataFrame) -> DataFrame:
    """Knowledge triples to write: three texts that are not blank, confidence within 0 to 1."""
    full = [F.length(F.trim(c)) > 0 for c in ("subject", "predicate", "object")]
    return rows.where(full[0] & full[1] & full[2]).withColumn("confidence", clamp(F.col("confidence"), 0.0, 1.0))


def validated_findings(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Reasoned findings with ``mutation_error``: citations present and of a known
    type, the file among the scanned ones, and the store gate passed."""
    from evidentia.operators.policy import store_gate

    known = files.select(F.col("path").alias("_p")).distinct()
    judged = store_gate(rows.join(known, rows.file_path == F.col("_p"), "left"), "pattern_scout")
    types = F.coalesce("citations", F.array().cast("array<string>"))
    error = (
        F.when(F.size(types) == 0, "no citations").when(F.exists(types, lambda t: ~t.isin("analyzer", "code", "hypothesis")), "unknown citation type")
        .when(F.col("_p").isNull(), "file not found").when(~F.col("allowed"), F.array_join("reasons", ","))
    )
    return judged.withColumn("mutation_error", error).drop("_p", "allowed", "reasons")


def pinned_model(models: DataFrame, columns: list[str]) -> DataFrame:
    """Threat models as JSON with sorted keys, and its SHA-256 as id."""
    body = F.to_json(F.struct(*sorted(columns)))
    return models.withColumn("json", body).withColumn("specifier_hash", F.sha2("json", 256))


def verified_model(models: DataFrame) -> DataFrame:
    """Whether a stored model still has the hash that it was pinned with."""
    return models.withColumn("hash_ok", F.sha2("json", 256) == F.col("specifier_hash"))


def cited_source_holds(proofs: DataFrame, lines: DataFrame) -> DataFrame:
    """Source proofs: every cited range of a proof contains its text, or none of the proof counts.

    ``proofs`` has proof_id, cite, file_path, line_start, line_end, expected; the
    ranges are put together from numbered ``lines``."""
    from evidentia.operators.intervals import contained

    cites = proofs.select("proof_id", "cite", F.col("file_path"), "line_start", "line_end", "expected")
    inside = contained(lines.select(F.col("file_path").alias("_f"), F.col("line").alias("_l"), "content"), cites, "_f", "_l")
    whole = inside.groupBy("proof_id", "cite").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", "content"))), lambda x: x["content"]), "\n").alias("_text"))
    each = cites.join(whole, ["proof_id", "cite"], "left").withColumn("_ok", F.coalesce(F.col("_text").contains(F.col("expected")), F.lit(False)))
    return each.groupBy("proof_id").agg(F.bool_and("_ok").alias("holds"), F.count(F.lit(1)).alias("n_cites"))
