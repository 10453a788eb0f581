"""Deliverables: SARIF, Markdown, the signed handoff seed, and their layout."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.scalars import envelope_id, sarif_level
from evidentia.numbering import number_in_order
from evidentia.operators import policy, rollups
from evidentia.scratch import Scratch, written

# Fixed values of the SARIF format.
SARIF_VERSION = "2.1.0"
SARIF_BETWEEN = ']}},"results":['  # from the rules to the results
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

Signer = Callable[[bytes], str]


def sarif_results(findings: DataFrame) -> DataFrame:
    """One rule and one result for each finding, in order, as structs."""
    rule = F.struct(F.col("id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(F.array(F.coalesce("cwe", F.lit(""))).alias("tags")).alias("properties"))
    region = F.struct(F.greatest("line_start", F.lit(1)).alias("startLine"), F.greatest("line_end", "line_start", F.lit(1)).alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("engagement_id", F.struct(F.col("id").alias("_id"), rule.alias("rule"), result.alias("result")).alias("r"))


def sarif(findings: DataFrame, tool: str = "evidentia", version: str = "0.1") -> DataFrame:
    """A SARIF document for each engagement as one row, for engagements of a size that a
    row can hold; :func:`sarif_parts` has no such bound."""
    rows = sarif_results(findings).groupBy("engagement_id").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0)).alias("rs"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rs", lambda r: r["rule"]).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rs", lambda r: r["result"]).alias("results"))
    body = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))
    return rows.select("engagement_id", F.to_json(body).alias("sarif"))


def sarif_parts(findings: DataFrame, tool: str = "evidentia", version: str = "0.1", rows: int = 5000) -> DataFrame:
    """A SARIF document for each engagement in parts (``engagement_id``, ``part``,
    ``text``): the texts of an engagement, in order and one after the other, are the
    document. A part has at most ``rows`` rules or results, so an engagement may
    have any number of findings. Findings are in the order of their ids."""
    scratch = Scratch(findings.sparkSession, "sarif")
    flat = scratch.keep(sarif_results(findings).select("engagement_id", F.col("r._id").alias("id"), F.to_json("r.rule").alias("rule"), F.to_json("r.result").alias("result")), "results")
    placed = scratch.keep(number_in_order(flat, ["engagement_id"], ["id", "result"], "place", scratch, total="total"), "placed")
    block = F.floor(F.col("place") / rows)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]), ",")
    blocks = placed.groupBy("engagement_id", block.alias("block")).agg(ordered("rule").alias("rule"), ordered("result").alias("result"), F.min("place").alias("least"), F.ceil(F.max("total") / rows).alias("blocks"))
    glued = lambda c: F.concat(F.when(F.col("least") > 0, ",").otherwise(""), c)
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"version":{json.dumps(version)},"rules":['
    part = lambda place, text: F.struct(place.cast("int").alias("part"), text.alias("text"))
    n, at = F.col("blocks"), F.col("block")
    fixed = F.array(part(F.lit(0), F.lit(head)), part(n + 1, F.lit(SARIF_BETWEEN)), part(2 * n + 2, F.lit("]}]}")))
    own = F.array(part(at + 1, glued("rule")), part(n + at + 2, glued("result")))
    return blocks.select("engagement_id", F.explode(F.when(F.col("least") == 0, F.concat(fixed, own)).otherwise(own)).alias("p")).select("engagement_id", "p.*")


SARIF_RESULT = "ruleId string, level string, locations array<struct<physicalLocation:struct<region:struct<startLine:int>>>>"


def sarif_from_parts(parts: DataFrame, result: str = SARIF_RESULT) -> DataFrame:
    """The results of documents that :func:`sarif_parts` wrote, with their places from 0
    (``engagement_id``, ``place``, ``result`` with the given fields). Each part is
    parsed by itself, so no task holds a document; what is no JSON, isn't joined
    by commas or lacks its frame or a part is an error."""
    scratch = Scratch(parts.sparkSession, "sarif-read")
    listed = (F.col("part") > 0) & ~F.col("text").startswith("]")
    items = F.from_json(F.concat(F.lit("["), F.when(F.col("text").startswith(","), F.expr("substring(text, 2)")).otherwise(F.col("text")), F.lit("]")), f"array<struct<{result}>>", {"mode": "FAILFAST"})
    read = scratch.keep(
        parts.select("engagement_id", "part", F.when(~listed, F.col("text")).alias("frame"), F.col("text").startswith(",").alias("goes_on"), F.when(listed, items).alias("rs")), "parts"
    )
    # a short row for each part: whether the results have begun, and how many items of its list come before
    sizes = read.select(F.col("engagement_id").alias("_e"), F.col("part").alias("_p"), "frame", F.coalesce(F.size("rs"), F.lit(0)).alias("n"))
    along = Window.partitionBy("_e").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("in_results", F.coalesce(F.max(F.col("frame") == SARIF_BETWEEN).over(along), F.lit(False)))
    before = Window.partitionBy("_e", "in_results").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("_p", "frame")))  # leaves out nulls
    frames = sizes.groupBy("_e").agg(F.array_join(F.transform(F.array_sort(fixed), lambda x: x["frame"]), "").alias("text"), (F.count(F.lit(1)) <= F.max("_p")).alias("gap"))
    empty = F.from_json("text", "version string, runs array<struct<results:array<string>>>")
    broken = frames.where(F.col("gap") | F.coalesce(F.size(empty["runs"][0]["results"]) != 0, F.lit(True))).select("_e").limit(1).collect()
    if broken:
        raise ValueError(f"parts of {broken[0][0]!r} make no document")
    starts = sizes.where("frame IS NULL AND in_results").select("_e", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    found = read.join(starts, (F.col("engagement_id") == F.col("_e")) & (F.col("part") == F.col("_p")))
    joined = F.when(F.col("goes_on") == (F.col("_start") > 0), F.col("rs")).otherwise(F.raise_error(F.lit("parts that no comma joins")).cast(found.schema["rs"].dataType))
    return found.select("engagement_id", "_start", F.posexplode(joined).alias("_at", "result")).select("engagement_id", (F.col("_start") + F.col("_at")).alias("place"), "result")


SEED_FINDING = [
    "id", "file_path", "line_start", "line_end", "severity", "cwe", "owasp", "title", "description", "citations", "advocate_verdict", "poc_status",
    "tool_origin", "evidence_envelope_id",
]
SEED_CHAIN = ["id", "stage", "finding_id", "evidence_id", "next_chain_id", "rationale"]
SEED_TRIPLE = ["id", "subject", "predicate", "object", "confidence", "rationale", "source_phase"]


def _entry(df: DataFrame, fields: list[str]) -> Column:
    have = set(df.columns)
    return F.to_json(F.struct(*((F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in fields)), {"ignoreNullFields": "false"})


def seed(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Findings that pass the handoff gate, with their citations' types, as JSON entries; the rest with the reasons."""
    judged = policy.handoff_gate(rollups.citation_types(findings, citations))
    return judged.select("engagement_id", "id", "allowed", "reasons", F.when(F.col("allowed"), _entry(judged, SEED_FINDING)).alias("entry"))


def seed_document(
    findings: DataFrame, citations: DataFrame, chains: DataFrame, triples: DataFrame, engagement_id: str, specifier_hash: str,
    generated_at: datetime | None = None, signer: Signer | None = None,
) -> tuple[dict, int, int]:
    """The handoff seed of one engagement, signed where a signer is given: findings that
    pass the gate, attack chains and knowledge triples, each in the order of ids;
    with the numbers of findings inside and filtered out. A seed is one document
    that is signed whole, so it is put together on the driver."""
    own = lambda df: df.where(F.col("engagement_id") == engagement_id)
    entries = seed(own(findings), citations).orderBy("id").select("allowed", "entry").toLocalIterator()
    inside, filtered = [], 0
    for row in entries:
        if row.allowed:
            inside.append(json.loads(row.entry))
        else:
            filtered += 1
    listed = lambda df, fields: [json.loads(r.e) for r in own(df).orderBy("id").select(_entry(df, fields).alias("e")).toLocalIterator()]
    at = (generated_at or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat()
    body = {
        "engagement_id": engagement_id, "specifier_hash": specifier_hash, "generated_at": at, "findings": inside,
        "attack_chains": listed(chains, SEED_CHAIN), "knowledge_triples": listed(triples, SEED_TRIPLE),
    }
    return {"signature": ""} | signed(body, signer), len(inside), filtered


def canonical(data: object) -> bytes:
    """JSON with sorted keys and no white space: what is hashed and signed."""
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def signed(data: dict, signer: Signer | None = None) -> dict:
    """The document with its hash, and a signature where a signer is given."""
    body = canonical(data)
    out = data | {"sha256": hashlib.sha256(body).hexdigest()}
    return out | {"signature": signer(body)} if signer else out


def verified(document: dict, verify: Callable[[bytes, str], bool] | None = None) -> bool:
    body = canonical({k: v for k, v in document.items() if k not in ("sha256", "signature")})
    fine = hashlib.sha256(body).hexdigest() == document.get("sha256")
    return fine and (verify is None or verify(body, document.get("signature", "")))


def card(findings: DataFrame) -> DataFrame:
    """A Markdown card for each finding, with its bucket's rank: ``severity``, ``id``, ``card``."""
    none = lambda c: F.coalesce(c, F.lit("none"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("### "), "id", F.lit(": "), F.coalesce("title", F.lit(""))), F.lit(""),
        F.concat(F.lit("- place: `"), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("`")),
        F.concat(F.lit("- cwe: "), none("cwe")), F.concat(F.lit("- verdict: "), none("advocate_verdict"), F.lit(", proof: "), none("poc_status")),
        F.lit(""), F.coalesce("description", F.lit("")), F.lit(""),
    )
    return findings.select("engagement_id", "severity", "id", text.alias("card"))


def markdown_lines(findings: DataFrame, chains: DataFrame, engagement_id: str) -> Iterator[str]:
    """Summary, chains and a card for every finding by severity of one engagement, a piece
    at a time: cards are sorted by the cluster and come a partition at a time."""
    mine = findings.where(F.col("engagement_id") == engagement_id)
    yield from (f"# Audit report {engagement_id}", "", "## Summary", "")
    for row in rollups.verdict_summary(mine).collect():
        yield from (f"- {k.replace('_', ' ')}: {v}" for k, v in row.asDict().items() if k != "engagement_id")
    yield from ("", "## Attack chains", "")
    stages = chains.where(F.col("engagement_id") == engagement_id).groupBy("stage").agg(F.count(F.lit(1)).alias("n")).orderBy("stage").collect()
    yield from [f"- {r.stage}: {r.n} nodes" for r in stages] or ["No chains."]
    buckets = {r.severity: r.n for r in rollups.severity_buckets(mine).collect()}
    shown = None
    cards = card(rollups.bucketed(mine))
    for r in cards.toLocalIterator():
        if r.severity != shown:
            shown = r.severity
            yield from ("", f"## {shown.capitalize()} ({buckets[shown]})", "")
        yield r.card


def markdown(findings: DataFrame, chains: DataFrame, engagement_id: str) -> str:
    """:func:`markdown_lines` as one text."""
    return "\n".join(markdown_lines(findings, chains, engagement_id)).rstrip() + "\n"


def write(root: str, engagement_id: str, files: dict[str, str | bytes], at: datetime | None = None) -> str:
    """Write deliverables to ``<root>/<engagement>/<UTC stamp>/`` and point ``latest`` there."""
    stamp = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ")
    folder = os.path.join(root, engagement_id, stamp)
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(body.encode() if isinstance(body, str) else body)
    link = os.path.join(root, engagement_id, "latest")
    new = link + ".new"
    if os.path.lexists(new):
        os.remove(new)
    os.symlink(stamp, new)
    os.replace(new, link)
    return folder


EVIDENCE = "envelope_id string, sha256 string, path string, content_type string"


def evidence(documents: DataFrame, folder: str) -> DataFrame:
    """Evidence rows for raw documents (``scan_id``, ``tool``, ``raw``): content-addressed, and
    written as ``<envelope_id>.json`` below ``folder`` (a URI or path that all
    executors share). Files are renamed when whole, so a repeated task writes the
    same bytes again; the rows are a written table, so reading them writes nothing."""
    data = F.encode("raw", "UTF-8")
    rows = documents.select(envelope_id(F.col("scan_id"), F.col("tool"), data).alias("envelope_id"), F.sha2(data, 256).alias("sha256"), "raw")
    target = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, hashes, raws = (batch.column(c) for c in ("envelope_id", "sha256", "raw"))
            paths = []
            for name, raw in zip(names.to_pylist(), raws):
                body = raw.as_py() or ""
                try:
                    body = json.dumps(json.loads(body), indent=2, ensure_ascii=False)
                except ValueError:
                    pass
                paths.append(f"{root}/{name}.json")
                own = f"{paths[-1]}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write(body.encode())
                store.move(own, paths[-1])
            yield pa.RecordBatch.from_arrays([names, hashes, pa.array(paths, pa.string()), pa.array(["application/json"] * len(paths), pa.string())], names=["envelope_id", "sha256", "path", "content_type"])

    return written(rows.mapInArrow(put, EVIDENCE), "evidence")
