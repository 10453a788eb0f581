"""One query for each operator that the other modules of queries do not show.

Every query calls the operator that it is named after, over whole tables; its
SQL says the same without it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import crosswalk, jobs, journal, mutate, policy, report, rollups, text, triage, vector
from evidentia.operators.extract import edges as edge_rows
from evidentia.operators.extract import facts as source_facts
from evidentia.operators.extract import symbols as symbol_rows
from evidentia.operators.normalize import NORMALISERS, normalise, responses
from evidentia.plans.audit_queries import RANK, _cited, query, table
from evidentia.plans.normaliser_queries import LINE, _docs, _events, _found, _sql
from evidentia.plans.views import view
from evidentia.scratch import Scratch, written
from evidentia.sources import files, threat_model
from evidentia.sources.manifests import requirement_lines
from evidentia.sources.store import Store

TEXT = lambda c: F.col(c).cast("string")

# --- scanners ------------------------------------------------------------------------------


@query(_sql("pip-audit", "'P-' || CAST(event_id AS VARCHAR)", "'requirements.txt'", "0", "0", "'high'", "'high'", "NULL", "CASE WHEN event_id % 2 = 0 THEN 'CVE-' || CAST(event_id AS VARCHAR) END", "event_type || ' 1: P-' || CAST(event_id AS VARCHAR)", "props || chr(10) || 'Fix versions: 2, 3'"))
def normalise_pip_audit(spark, d):
    n = TEXT("event_id")
    aliases = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("GHSA-1"), F.concat(F.lit("CVE-"), n))).otherwise(F.array(F.lit("GHSA-2")))
    one = F.struct(F.concat(F.lit("P-"), n).alias("id"), aliases.alias("aliases"), F.array(F.lit("2"), F.lit("3")).alias("fix_versions"), F.col("props").alias("description"))
    item = F.struct(F.col("event_type").alias("name"), F.lit("1").alias("version"), F.array(one).alias("vulns"))
    return _found(NORMALISERS["pip_audit"](_docs(table(spark, d, "events"), item, "dependencies")))


@query(_sql("cargo-audit", "'R-' || CAST(event_id AS VARCHAR)", "'Cargo.toml'", "0", "0", "CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'critical' ELSE 'medium' END", "'high'", "NULL", "NULL", "'R-' || CAST(event_id AS VARCHAR) || ': ' || event_type", "props || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'Package: p 1' || chr(10) || 'Patched: >=2' ELSE '' END"))
def normalise_cargo_audit(spark, d):
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "CRITICAL")
    advisory = F.struct(F.concat(F.lit("R-"), TEXT("event_id")).alias("id"), F.col("event_type").alias("title"), F.col("props").alias("description"), severity.alias("severity"))
    patched = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(">=2"))).otherwise(F.array().cast("array<string>"))
    item = F.struct(advisory.alias("advisory"), F.struct(F.lit("p").alias("name"), F.lit("1").alias("version")).alias("package"), F.struct(patched.alias("patched")).alias("versions"))
    docs = _docs(table(spark, d, "events"), item, "list")
    return _found(NORMALISERS["cargo_audit"](docs.withColumn("raw", F.concat(F.lit('{"vulnerabilities":'), "raw", F.lit("}")))))


@query(_sql("clippy", "'clippy::unwrap_used'", "'src/u' || CAST(user_id AS VARCHAR) || '.py'", LINE, f"{LINE} + 1", "CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END", "'medium'", "'CWE-248'", "NULL", "props", "props", "events WHERE event_id % 3 <> 0"))
def normalise_clippy(spark, d):
    spans = F.array(F.struct(F.col("path").alias("file_name"), F.col("line").alias("line_start"), (F.col("line") + 1).alias("line_end"), F.lit(True).alias("is_primary")))
    message = F.struct(F.struct(F.lit("clippy::unwrap_used").alias("code")).alias("code"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("level"), F.col("props").alias("message"), spans.alias("spans"))
    item = F.struct(F.when(F.col("event_id") % 3 == 0, "build-finished").otherwise("compiler-message").alias("reason"), message.alias("message"))
    return _found(NORMALISERS["clippy"](_docs(_events(spark, d), item, join="\n")))


@query(_sql("tfsec", "event_type", "'main.tf'", LINE, f"{LINE} + 2", "CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'medium' END", "'high'", "NULL", "NULL", "'tfsec ' || event_type || ': ' || props", "props || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || 'Resolution: fix' ELSE '' END"))
def normalise_tfsec(spark, d):
    at = F.struct(F.lit("/main.tf").alias("filename"), F.col("line").alias("start_line"), (F.col("line") + 2).alias("end_line"))
    item = F.struct(F.col("event_type").alias("rule_id"), F.col("props").alias("description"), F.when(F.col("event_id") % 2 == 0, "CRITICAL").alias("severity"), F.when(F.col("event_id") % 3 == 0, "fix").alias("resolution"), at.alias("location"))
    return _found(NORMALISERS["tfsec"](_docs(_events(spark, d), item, "results")))


@query(_sql("progpilot", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'taint' END", "'src/u' || CAST(user_id AS VARCHAR) || '.py'", LINE, LINE, "'high'", "'medium'", "CASE WHEN event_id % 3 = 0 THEN 'CWE-89' END", "NULL", "'Progpilot: ' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'taint' END", "'Tainted data from ' || CASE WHEN event_id % 2 = 0 THEN 'a, b' ELSE 'tainted input' END || ' reaches sink echo.'"))
def normalise_progpilot(spark, d):
    even = F.col("event_id") % 2 == 0
    item = F.struct(F.lit("echo").alias("sink_name"), F.col("path").alias("sink_file"), F.col("line").alias("sink_line"), F.when(even, F.col("event_type")).alias("vuln_name"), F.when(F.col("event_id") % 3 == 0, "CWE_89").otherwise("none").alias("vuln_cwe"), F.when(even, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("source_name"))
    return _found(NORMALISERS["progpilot"](_docs(_events(spark, d), item)))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'tfsec' ELSE 'ruff' END AS tool, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'S' || event_type END AS rule_id, count(*) AS n FROM events GROUP BY ALL")
def normalise_union(spark, d):
    """Documents of several tools, and of one that is not known, in one run."""
    e = table(spark, d, "events")
    item = F.struct(F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("rule_id"), F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("S"), "event_type")).alias("code"))
    arrays = _docs(e, item)
    tool = F.when(F.col("user_id") % 2 == 0, "tfsec").otherwise("ruff")
    raw = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"results":'), "raw", F.lit("}"))).otherwise(F.col("raw"))
    docs = arrays.select("user_id", tool.alias("tool_name"), raw.alias("raw")).unionByName(arrays.select("user_id", F.lit("unheard-of").alias("tool_name"), "raw"))
    return normalise(docs).groupBy("tool", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, (event_id % 7 = 0 OR ((CASE WHEN event_type = 'click' THEN event_id % 5 IN (0, 1, 3) ELSE event_id % 5 IN (0, 1) END) AND event_id % 3 <> 0 AND event_id % 4 <> 0)) AS usable FROM events""")
def usable_responses(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "click", "govulncheck").otherwise("ruff").alias("tool"), (F.col("event_id") % 7 == 0).alias("ok"),
        (F.col("event_id") % 5).cast("int").alias("exit_code"), F.when(F.col("event_id") % 4 == 0, "").otherwise("[]").alias("stdout"),
        F.lit("").alias("stderr"), F.lit(None).cast("string").alias("raw_json"), F.when(F.col("event_id") % 3 == 0, "failed").alias("error"),
    )
    return responses(e).select("event_id", "usable")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 5 = 1 THEN 'critical' ELSE 'info' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM events")
def known_levels(spark, d):
    severity = F.when(F.col("event_id") % 5 == 0, "HIGH").when(F.col("event_id") % 5 == 1, "Critical").when(F.col("event_id") % 5 == 2, "odd")
    confidence = F.when(F.col("event_id") % 3 == 0, "Medium").when(F.col("event_id") % 3 == 1, "?")
    return table(spark, d, "events").select("event_id", S.known_severity(severity).alias("severity"), S.known_confidence(confidence).alias("confidence"))


# --- source trees ----------------------------------------------------------------------------

_PATHS = """CASE doc_id % 7 WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN 'lib/B' || doc_id || '.RS' WHEN 2 THEN '.github/workflows/c' || doc_id || '.yml'
WHEN 3 THEN 'node_modules/d' || doc_id || '.js' WHEN 4 THEN 'web/e' || doc_id || '.tsx' WHEN 5 THEN 'd' || doc_id || '/Dockerfile' ELSE 'notes/_f' || doc_id END"""
_LANGUAGE = "CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'yaml' WHEN 4 THEN 'tsx' WHEN 5 THEN 'dockerfile' END"


def _tree(spark, d):
    """The documents as a tree of files in the shared folder, written by tasks."""
    import pyarrow as pa
    from pyarrow import fs

    root = f"{Scratch(spark, 'tree').root}/files"
    root = root if "://" in root else "file://" + root.removeprefix("file:")

    def put(batches):
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    table(spark, d, "documents").select(F.expr(_PATHS).alias("path"), "text").mapInArrow(put, "n long").agg(F.sum("n")).first()
    return root


@query(f"SELECT {_PATHS} AS path, {_LANGUAGE} AS language, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 7 <> 3")
def source_scan(spark, d):
    found = files.scan(spark, _tree(spark, d))
    return found.select("path", files.language(F.col("path")).alias("language"), "length", F.sha2("content", 256).alias("sha"))


_FILES = f"SELECT lang AS engagement_id, {_PATHS} AS path, coalesce(text, '') AS text FROM documents"


@query(f"""WITH f AS (SELECT lang AS engagement_id, doc_id, {_LANGUAGE} AS l FROM documents)
SELECT engagement_id, list_sort(list_distinct(flatten(list(CASE WHEN l = 'dockerfile' THEN ['dockerfile', 'iac'] WHEN l = 'yaml' THEN ['yaml', 'iac'] WHEN l = 'tsx' THEN ['tsx', 'typescript'] WHEN doc_id % 7 = 3 THEN ['javascript'] WHEN l IS NULL THEN [] ELSE [l] END)))) AS languages
FROM f GROUP BY engagement_id""")  # fmt: skip
def tree_overview(spark, d):
    tree = spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return files.overview(tree, ["engagement_id"]).select("engagement_id", "languages")


@query("SELECT doc_id FROM documents WHERE (starts_with(source, 'src1') OR starts_with(source, 'src2')) AND NOT starts_with(source, 'src13')")
def in_scope(spark, d):
    return files.in_scope(table(spark, d, "documents"), ["src1", "src2"], ["src13"], "source").select("doc_id")


@query("SELECT DISTINCT lang AS engagement_id, 'python' AS language FROM documents UNION SELECT DISTINCT lang, 'rust' FROM documents")
def language_facts(spark, d):
    """Facts of an overview, and the languages found in them."""
    tree = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 2 == 0, "a.py").otherwise("b.rs").alias("path"), "text")
    facts = None
    for r in tree.select("lang").distinct().orderBy("lang").collect():  # engagements, as many as languages of the table
        one = files.facts(files.overview(tree.where(F.col("lang").eqNullSafe(r.lang))), r.lang)
        facts = one if facts is None else facts.unionByName(one)
    return jobs.detected_languages(facts)


@query("SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def lines_of(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.lines_of(F.col("text")).alias("lines"))


@query("""SELECT doc_id, array_to_string(l[greatest(1, doc_id % 4) : least(CAST(doc_id % 4 + 1 AS INT), len(l))], chr(10)) AS body
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def symbol_bodies(spark, d):
    n = (F.col("doc_id") % 4).cast("int")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.body(F.col("text"), n, n + 1).alias("body"))


@query("SELECT file_path, line_start, line_end, kind, name FROM symbols WHERE name = 'f77'", "symbols")
def symbols_named(spark, d):
    return text.symbols_named(view(spark, d, "symbols"), "f77")


@query("""SELECT CAST(doc_id AS VARCHAR) || ':1-' || CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS VARCHAR) AS id,
decode(unhex(regexp_extract(hex(encode(text))[1 : 2 * 4096], '^((?:[0-7].|C.[89AB].|D.[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)*)', 1))) AS text
FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]')""")  # fmt: skip
def chunks(spark, d):
    sources = table(spark, d, "documents").select(TEXT("doc_id").alias("path"), F.lit("rust").alias("language"), "text")
    none = spark.createDataFrame([], "file_path string, line_start int, line_end int, kind string, name string, language string")
    return text.chunks(sources, none).select("id", "text")


@query(""", inside AS (SELECT p.file, p.line, s.name, s.kind, row_number() OVER (PARTITION BY p.file, p.line ORDER BY s.line_end - s.line_start, s.line_start DESC, s.name) AS n
FROM (SELECT DISTINCT file, line FROM points) p JOIN symbols s ON p.file = s.file_path AND p.line BETWEEN s.line_start AND s.line_end)
SELECT p.file, p.line, i.name, i.kind FROM (SELECT DISTINCT file, line FROM points) p LEFT JOIN (SELECT * FROM inside WHERE n = 1) i USING (file, line)""", "points", "symbols")  # fmt: skip
def point_context(spark, d):
    sources = view(spark, d, "symbols").select(F.col("file_path").alias("path")).distinct().withColumn("text", F.lit("import x\ny\n"))
    return text.context(view(spark, d, "points"), view(spark, d, "symbols"), sources).select("file", "line", "name", "kind")


# Sources rendered from orders, a file each; what must be found follows from the order's number.
_SOURCES = {
    "python": ("def f{n}(q):\n    a{n} = b\n    run(a{n})\n    return a{n}\n", "function", "f{n}"),
    "rust": ("fn f{n}<'a>(q: &'a str) {{\n    let a{n} = b;\n    run(a{n});\n    return a{n};\n}}\n", "function", "f{n}"),
    "go": ("func f{n}(q string) {{\n    a{n} := b\n    run(a{n})\n    return a{n}\n}}\n", "function", "f{n}"),
    "java": ("class C {{ void f{n}(int q) {{\n    int a{n} = b;\n    run(a{n});\n    return a{n};\n}} }}\n", "method", "f{n}"),
    "php": ("<?php function f{n}($q) {{\n    $a{n} = $b;\n    run($a{n});\n    return $a{n};\n}}\n", "method", "f{n}"),
    "typescript": ("function f{n}(q) {{\n    const a{n} = b\n    run(a{n})\n    return a{n}\n}}\n", "function", "f{n}"),
}


def _sources(spark, d, language):
    body = _SOURCES[language][0].replace("{{", "{").replace("}}", "}")
    path = F.concat(F.lit("s/"), TEXT("o_orderkey"))
    return table(spark, d, "orders").select(path.alias("path"), F.lit(language).alias("language"), F.replace(F.lit(body), F.lit("{n}"), TEXT("o_orderkey")).alias("text"))


def _edge_sql(language):
    var = "$" if language == "php" else ""
    at = "'s/' || k || ':f' || k || ':'"
    return f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders)
SELECT {at} || '{var}b' AS from_symbol, {at} || '{var}a' || k AS to_symbol, 'assign' AS edge_kind, 2 AS line FROM o
UNION ALL SELECT {at} || '{var}a' || k, {at} || 'run', 'call_arg', 3 FROM o
UNION ALL SELECT {at} || '{var}a' || k, {at} || '<return>', 'return', 4 FROM o"""


def _extraction(language):
    def edges(spark, d):
        return edge_rows(source_facts(_sources(spark, d, language)), "e").select("from_symbol", "to_symbol", "edge_kind", "line")

    edges.__name__ = f"edges_of_{language}"
    query(_edge_sql(language))(edges)


for _language in _SOURCES:
    _extraction(_language)


@query("WITH k(language, kind) AS (VALUES " + ", ".join(f"('{x}', '{kind}')" for x, (_, kind, _) in _SOURCES.items()) + """)
SELECT language, kind, 'f' || CAST(o_orderkey AS VARCHAR) AS name FROM orders, k UNION ALL SELECT 'java', 'class', 'C' FROM orders""")
def source_symbols(spark, d):
    """Functions, methods and classes of six languages."""
    all_ = None
    for language in _SOURCES:
        all_ = _sources(spark, d, language) if all_ is None else all_.unionByName(_sources(spark, d, language))
    return symbol_rows(source_facts(all_, symbols_only=True), "e").select("language", "kind", "name")


@query("""SELECT 's/' || CAST(o_orderkey AS VARCHAR) AS source_file, 'p' || CAST(o_custkey AS VARCHAR) AS name, '>=' || CAST(o_orderkey % 9 AS VARCHAR) || '.1' AS version_spec, 1 AS ordinal FROM orders
UNION ALL SELECT 's/' || CAST(o_orderkey AS VARCHAR), 'bare', '', 3 FROM orders""")
def requirements(spark, d):
    line = F.concat(F.lit("# deps\np"), TEXT("o_custkey"), F.lit("[x] >="), (F.col("o_orderkey") % 9).cast("string"), F.lit(".1  # why\n-r other\nbare\n"))
    found = requirement_lines(table(spark, d, "orders").select(F.concat(F.lit("s/"), TEXT("o_orderkey"), F.lit("/requirements.txt")).alias("path"), line.alias("text")))
    return found.select(F.regexp_replace("source_file", "/requirements.txt$", "").alias("source_file"), "name", "version_spec", "ordinal")


# --- store, vectors, journal ------------------------------------------------------------------


@query("SELECT engagement_id, id, severity, title FROM findings WHERE engagement_id <> 'eng-1' UNION ALL SELECT 'eng-1', id, 'info', title FROM findings WHERE engagement_id = 'eng-1' AND ordinal % 2 = 0", "findings")
def store_round_trip(spark, d):
    """Append, insert-or-ignore of the same rows, and the overwrite of one engagement."""
    store, f = Store(spark, f"{Scratch(spark, 'store').root}/evidence", buckets=16), view(spark, d, "findings")
    store.append("findings", f.where("ordinal % 3 = 0"))
    store.insert_or_ignore("findings", f, ["created_at"])
    mine = store.read("findings", "eng-1").join(f.where("ordinal % 2 = 0").select("id"), "id", "left_semi")
    store.overwrite_engagement("findings", "eng-1", mine.withColumn("severity", F.lit("info")))
    return store.read("findings").select("engagement_id", "id", "severity", "title")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS engagement_id, list_transform(range(4), lambda i: CASE WHEN i < strlen(text) THEN CAST(('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2]) AS INT) ELSE 0 END) AS bytes, n_chars
FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def vector_collection(spark, d):
    """Embedding by the stand-in provider, insertion, reading, and payloads."""
    c = vector.Collection(spark, f"{Scratch(spark, 'vectors').root}/collection", 4)
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("engagement_id"), "text", "n_chars")
    c.insert(vector.indexed(docs, "doc", vector.byte_embedder(4), 4), distinct=True)
    rows = c.read()
    payload = vector.decoded(rows.select("id", F.lit(0.0).alias("distance"), "text"), "n_chars bigint").select(F.col("id").alias("_id"), "n_chars")
    both = rows.join(payload, rows.id == payload._id)
    return both.select("id", "engagement_id", F.transform("vector", lambda v: F.round(v * 255).cast("int")).alias("bytes"), "n_chars")


@query("SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2, 4) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distances(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("_v"), F.col("embedding").alias("_e"))
    return e.join(b, e.vec_id == b._v).select("vec_id", F.round(vector.squared_l2(F.col("embedding"), F.col("_e")), 4).alias("distance"))


_BODY = """'{"timestamp":"t' || turn || '","principal":"' || role || '","action":"say","resource":"' || n || '","cedar_decision":"permit","envelope_id":null,"prev_hash":"' || %s || '","entry_hash":""}'"""


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
chain AS (SELECT conv_id, k, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || {_BODY % "repeat('0', 64)"}) AS own FROM c WHERE k = 0
UNION ALL SELECT c.conv_id, c.k, own, sha256(own || '|' || {_BODY % "own"}) FROM chain JOIN c ON c.conv_id = chain.conv_id AND c.k = chain.k + 1)
SELECT conv_id AS journal, CAST(k AS INT) AS ordinal, own AS entry_hash, true AS link_ok, NOT (conv_id % 5 = 0 AND k = 1) AS hash_ok FROM chain""")  # fmt: skip
def journal_hashes(spark, d):
    return journal.links(journal.parsed(_journals(spark, d))).select("journal", F.col("ordinal").cast("int").alias("ordinal"), "entry_hash", "link_ok", "hash_ok")


@query("""SELECT conv_id AS journal, CASE WHEN conv_id % 5 = 0 AND count(*) > 1 THEN 1 END AS first_bad, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE count(*) END AS n_valid FROM conversations GROUP BY conv_id""")
def journal_verdicts(spark, d):
    return journal.first_break(journal.links(journal.parsed(_journals(spark, d))))


def _journals(spark, d):
    """Journals rendered entry by entry, one body in five tampered with, written as files and read back."""
    import pandas as pd

    def render(pdf):
        last, out = journal.GENESIS, []
        for k, r in enumerate(pdf.sort_values("turn").itertuples()):
            line = journal.entry_line({"timestamp": f"t{r.turn}", "principal": r.role, "action": "say", "resource": str(r.n), "cedar_decision": "permit"}, last)
            last = line.rsplit('"entry_hash":"', 1)[1][:64]
            out.append((r.conv_id, k, line.replace('"action":"say"', '"action":"lie"') if r.conv_id % 5 == 0 and k == 1 else line))
        return pd.DataFrame(out, columns=["journal", "ordinal", "line"])

    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    at = f"{Scratch(spark, 'journals').root}/files"
    rendered = turns.groupBy("conv_id").applyInPandas(render, "journal long, ordinal int, line string")
    rendered.sortWithinPartitions("journal", "ordinal").select("journal", "line").write.partitionBy("journal").text(at)
    lines = journal.read_lines(spark, at)
    return lines.withColumn("journal", F.regexp_extract("journal", "/journal=([0-9]+)/", 1).cast("long"))


# --- findings, mutations, rules -----------------------------------------------------------------


@query("""SELECT id, engagement_id, severity, title, status, CAST(NULL AS DOUBLE) AS rank_score, poc_status, CASE WHEN severity = 'info' THEN 'advocate_verdict' END AS decode_error FROM
(SELECT * FROM findings)""", "findings")  # fmt: skip
def whole_findings(spark, d):
    odd = view(spark, d, "findings").withColumn("advocate_verdict", F.when(F.col("severity") == "info", "odd").otherwise(F.col("advocate_verdict")))
    return triage.whole(odd).select("id", "engagement_id", "severity", "title", "status", "rank_score", "poc_status", "decode_error")


@query("SELECT id, CASE ordinal % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'confirmed' ELSE advocate_verdict END AS advocate_verdict FROM findings", "findings")
def verdicts(spark, d):
    """Two verdicts for some findings: the later one counts."""
    f = view(spark, d, "findings")
    row = lambda where, verdict, at: f.where(where).select("engagement_id", "id", F.lit(verdict).alias("verdict"), F.lit(at).alias("at"))
    new = row("ordinal % 3 = 0", "rebutted", 1).unionByName(row("ordinal % 3 = 0", "uncertain", 2)).unionByName(row("ordinal % 3 = 1", "confirmed", 1))
    return mutate.set_verdicts(f, new).select("id", "advocate_verdict")


@query("""SELECT id AS finding_id, 'poc' AS citation_type, CAST(NULL AS VARCHAR) AS code_path, CAST(NULL AS INT) AS code_line_start, title AS intended_poc FROM findings WHERE ordinal % 4 = 0
UNION ALL SELECT id, 'code', file_path, line_start, NULL FROM findings WHERE ordinal % 4 = 1 UNION ALL SELECT id, 'hypothesis', NULL, NULL, title FROM findings WHERE ordinal % 4 = 2""", "findings")  # fmt: skip
def citation_records(spark, d):
    """Exhibits, and citations flattened to the columns of their type."""
    f = view(spark, d, "findings")
    made = mutate.exhibits(f.where("ordinal % 4 = 0").select("engagement_id", F.col("id").alias("finding_id"), F.col("title").alias("exhibit")))
    kind = F.when(F.col("ordinal") % 4 == 1, "code").when(F.col("ordinal") % 4 == 2, "hypothesis").otherwise("rumour")
    cited = f.where("ordinal % 4 > 0").select("engagement_id", F.col("id").alias("finding_id"), kind.alias("citation_type"), F.col("file_path").alias("code_path"), F.col("line_start").alias("code_line_start"), F.col("title").alias("intended_poc"))
    return made.unionByName(mutate.citation_rows(cited)).select("finding_id", "citation_type", "code_path", "code_line_start", "intended_poc")


@query("SELECT event_id, event_id % 11 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR (event_id % 3 <> 0 AND event_id % 2 <> 0) AS environmental FROM events")
def environmental_runs(spark, d):
    n = F.col("event_id")
    error = F.when(n % 7 == 0, "broke")
    return table(spark, d, "events").select("event_id", mutate.is_environmental(n % 11 == 0, n % 5 != 0, error, (n % 3).cast("int"), n % 2 == 0).alias("environmental"))


@query("""SELECT id, CASE WHEN ordinal % 5 = 3 OR ordinal % 5 = 4 THEN 'no citations' WHEN ordinal % 5 = 2 THEN 'unknown citation type' WHEN line_start % 2 = 1 THEN 'file not found'
WHEN evidence_envelope_id = '' AND specifier_hash IS NULL THEN 'store-needs-envelope,store-needs-specifier-hash' WHEN evidence_envelope_id = '' THEN 'store-needs-envelope'
WHEN specifier_hash IS NULL THEN 'store-needs-specifier-hash' END AS mutation_error FROM findings""", "findings")  # fmt: skip
def validated_findings(spark, d):
    f = _cited(spark, d).withColumn("file_path", F.concat("file_path", F.lit("#"), (F.col("line_start") % 2).cast("string")))
    known = f.where("file_path LIKE '%#0'").select(F.col("file_path").alias("path")).distinct()
    return mutate.validated_findings(f, known).select("id", "mutation_error")


@query("""SELECT o_orderkey, sha256('{"sinks":"' || o_orderpriority || '","sources":"' || o_orderstatus || '"}') AS specifier_hash, o_orderkey % 3 <> 0 AS hash_ok FROM orders""")
def pinned_models(spark, d):
    models = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sources"), F.col("o_orderpriority").alias("sinks"))
    pinned = mutate.pinned_model(models, ["sources", "sinks"])
    touched = pinned.withColumn("json", F.when(F.col("o_orderkey") % 3 == 0, F.concat("json", F.lit(" "))).otherwise(F.col("json")))
    return mutate.verified_model(touched).select("o_orderkey", "specifier_hash", "hash_ok")


@query("SELECT o_custkey AS proof_id, bool_and(o_orderkey % 5 <> 0) AS holds, count(*) AS n_cites FROM orders GROUP BY 1")
def cited_sources(spark, d):
    """A proof holds if each of its cites does: here the text of one line, or of the next one."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    path, k = F.concat(F.lit("f"), TEXT("o_orderkey")), F.col("o_orderkey")
    lines = o.select(path.alias("file_path"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("line"), TEXT("o_orderkey").alias("k")).select("file_path", "line", F.concat(F.lit("text "), "k", F.lit(" "), TEXT("line")).alias("content"))
    expected = F.concat(F.lit("text "), TEXT("o_orderkey"), F.when(k % 5 == 0, " 3").otherwise(" 2"))
    proofs = o.select(F.col("o_custkey").alias("proof_id"), k.alias("cite"), path.alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), expected.alias("expected"))
    return mutate.cited_source_holds(proofs, lines)


@query("SELECT engagement_id, count(*) FILTER (severity = 'high') AS unguarded, count(*) FILTER (severity <> 'high') AS guarded FROM findings GROUP BY 1", "findings")
def guard_totals(spark, d):
    seen = F.when(F.col("severity") == "high", F.array(F.lit("unguarded"))).when(F.col("severity") == "low", F.array().cast("array<string>"))
    return rollups.guard_totals(view(spark, d, "findings").select("engagement_id", seen.alias("sanitizers_seen")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'CWE-' || CAST(event_id % 50 AS VARCHAR) END AS cwe FROM events")
def first_match(spark, d):
    cwe = F.concat(F.lit("CWE-"), (F.col("event_id") % 50).cast("string"))
    names = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("CVE-1"), cwe, F.lit("CWE-last"))).otherwise(F.array(F.lit("GO-1")))
    return table(spark, d, "events").select("event_id", rollups.first_match(names, "CWE-").alias("cwe"))


@query("SELECT id, subject FROM triples ORDER BY id LIMIT 30 OFFSET 30", "triples")
def triples_page(spark, d):
    return triage.page(view(spark, d, "triples").select("id", "subject"), [F.col("id").asc()], 1)


@query(f"SELECT id, severity FROM findings WHERE cwe IN ('CWE-89','CWE-78','CWE-22','CWE-94','CWE-79') AND status = 'open' AND poc_status IS NULL ORDER BY {RANK} DESC, id LIMIT 50 OFFSET 50", "findings")
def candidates_page(spark, d):
    return triage.page(triage.proof_candidates(view(spark, d, "findings")).select("id", "severity"), triage.by_priority(), 1, 50)


@query("SELECT CAST(o_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, CAST(l_linenumber AS INT) AS step FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY 1 LIMIT 30 OFFSET 60")
def chain_nodes_page(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(TEXT("l_orderkey"), F.lit("-"), TEXT("l_linenumber")).alias("id"), F.col("l_linenumber").cast("int").alias("step"))
    return triage.page(rows, [F.col("id").asc()], 2)


@query("""SELECT l_orderkey, l_linenumber, lead(CAST(l_suppkey AS VARCHAR)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next_chain_id FROM lineitem""")
def linked_nodes(spark, d):
    """Nodes that come one by one, linked by their order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", TEXT("l_suppkey").alias("id"))
    return mutate.linked(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "next_chain_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type = 'click' WHEN 1 THEN event_type IN ('click', 'view') WHEN 2 THEN event_type = 'error' ELSE false END AS allowed FROM events""")
def tool_rules(spark, d):
    """Tools by principal and resource type; writes by table; the network is closed."""
    n, kind = F.col("event_id") % 4, F.col("event_type")
    rows = table(spark, d, "events").select(
        "event_id", F.when(n == 0, "static_hunter").when(n == 1, "cartographer").when(n == 2, "cartographer").otherwise("audit-controller").alias("principal"),
        F.when(n < 2, "execute_tool").when(n == 2, "write").otherwise("network").alias("action"),
        F.when(n == 0, F.when(kind == "click", "Audit::StaticHunter").otherwise("Audit::RepoIntel")).when(n == 1, F.when(kind == "click", "Audit::RepoIntel").when(kind == "view", "Audit::Journal").otherwise("Audit::StaticHunter")).alias("type"),
        F.when(kind == "error", "routes").otherwise("findings").alias("table"), F.lit("token").alias("step_up_token"),
    )
    return policy.authorise(rows).select("event_id", "allowed")


# --- deliverables ----------------------------------------------------------------------------------


@query("""SELECT engagement_id, id AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, greatest(line_start, 1) AS start_line,
row_number() OVER (PARTITION BY engagement_id ORDER BY id) - 1 AS place FROM findings""", "findings")  # fmt: skip
def sarif_documents(spark, d):
    """The documents written in parts and read back part by part."""
    read = report.sarif_from_parts(report.sarif_parts(view(spark, d, "findings"), rows=500))
    return read.select("engagement_id", F.col("result.ruleId").alias("rule_id"), "result.level", F.col("result.locations")[0]["physicalLocation"]["region"]["startLine"].alias("start_line"), "place")


@query("""SELECT id, coalesce(advocate_verdict, '') IN ('confirmed', 'uncertain') AND coalesce(poc_status, '') <> 'refuted' AND severity NOT IN ('low', 'info')
AND (coalesce(poc_status, '') = 'reproduced' OR advocate_verdict = 'confirmed' OR ordinal % 2 = 0) AS allowed FROM findings""", "findings")  # fmt: skip
def seed_entries(spark, d):
    f = view(spark, d, "findings")
    cites = f.where("ordinal % 2 = 0").select("engagement_id", F.col("id").alias("finding_id"), F.lit("analyzer").alias("citation_type"))
    got = report.seed(f, cites)
    fine = F.get_json_object("entry", "$.id") == F.col("id")
    return got.select("id", (F.col("allowed") & F.coalesce(fine, ~F.col("allowed"))).alias("allowed"))


@query("""SELECT id, '### ' || id || ': ' || title || chr(10) || chr(10) || '- place: `' || file_path || ':' || line_start || '-' || line_end || '`' || chr(10) || '- cwe: ' || coalesce(cwe, 'none') || chr(10)
|| '- verdict: ' || coalesce(advocate_verdict, 'none') || ', proof: ' || coalesce(poc_status, 'none') || chr(10) || chr(10) || description || chr(10) AS card FROM findings""", "findings")  # fmt: skip
def report_cards(spark, d):
    return report.card(rollups.bucketed(view(spark, d, "findings"))).select("id", "card")


@query("""SELECT id, title, 'new' AS status, CASE severity WHEN 'medium' THEN 'moderate' WHEN 'info' THEN 'unknown' ELSE severity END AS risk, 'technology' AS category FROM findings WHERE cwe IN ('CWE-89', 'CWE-78', 'CWE-22', 'CWE-798')""", "findings")
def risk_payloads(spark, d):
    f = view(spark, d, "findings")
    one = crosswalk.payloads(f, "gapps").select("id", F.from_json("payload", "title string, status string, risk string").alias("p"))
    two = crosswalk.payloads(f, "comp").select(F.col("id").alias("_id"), F.get_json_object("payload", "$.category").alias("category"))
    return one.join(two, one.id == two._id).select("id", "p.*", "category")


@query("SELECT 'S-' || source || '-t-' || substr(sha256(coalesce(text, '')), 1, 12) AS envelope_id, sha256(coalesce(text, '')) AS sha256, 'application/json' AS content_type FROM documents")
def evidence_files(spark, d):
    scratch = Scratch(spark, "evidence-files")
    docs = table(spark, d, "documents").select(F.concat(F.lit("S-"), "source").alias("scan_id"), F.lit("t").alias("tool"), F.coalesce("text", F.lit("")).alias("raw"))
    return report.evidence(docs, f"{scratch.root}/files").select("envelope_id", "sha256", "content_type")


# --- scalars ----------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' END AS language, event_id % 5 NOT IN (2, 4) AS path_ok, event_id % 2 = 0 AS cwe_ok, event_type IN ('error') AS level_ok FROM events""")
def argument_domains(spark, d):
    n = F.col("event_id")
    path = F.when(n % 5 == 0, "src/A.PY").when(n % 5 == 1, "web/b.tsx").when(n % 5 == 2, "/abs/c.mjs").when(n % 5 == 3, "Makefile").otherwise("a/../b.zip")
    cwe = F.concat(F.lit("CWE-"), TEXT("event_id"), F.when(n % 2 == 0, "").otherwise("x"))
    level = F.when(F.col("event_type") == "error", "high").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.sandbox_language(path).alias("language"), S.valid_argument(path, "file_path").alias("path_ok"), S.valid_argument(cwe, "cwe_id").alias("cwe_ok"), S.valid_argument(level, "severity_level").alias("level_ok"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS stamp, true AS same, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS folder FROM events""")
def time_stamps(spark, d):
    stamp = S.to_rfc3339(F.col("ts"))
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), (S.from_rfc3339(stamp) == F.col("ts")).alias("same"), S.path_stamp(F.col("ts")).alias("folder"))


@query("SELECT event_id, event_type || '-3-5' AS model, event_type AS provider, 'm:' || CAST(user_id AS VARCHAR) AS tier_model, CAST(user_id AS VARCHAR) || CAST(event_id AS VARCHAR) AS digits FROM events")
def model_names(spark, d):
    name = F.concat(F.lit("router/x/"), "event_type", F.lit("-3.5"))
    tier = S.tier(F.concat("event_type", F.lit(":m:"), TEXT("user_id")))
    return table(spark, d, "events").select("event_id", S.canonical_model(name).alias("model"), tier["provider"].alias("provider"), tier["model"].alias("tier_model"), S.digits(F.concat(F.lit("CWE_"), TEXT("user_id"), F.lit(" v"), TEXT("event_id"))).alias("digits"))


_PATTERNS = ", ".join(
    f"('{role}', '{lang}', '{p.replace(chr(39), chr(39) * 2)}')" for role, t in threat_model.ROLES.items() for lang, ps in [*t.items(), *((new, t.get(old, [])) for new, old in threat_model.SAME.items())] for p in ps
)


@query(f", p(role, language, pattern) AS (VALUES {_PATTERNS}) SELECT role, engagement_id, count(*) AS n FROM p JOIN languages USING (language) GROUP BY ALL", "languages")
def threat_patterns(spark, d):
    """Default patterns of the languages of each engagement."""
    both = F.broadcast(threat_model.defaults(spark)).join(view(spark, d, "languages"), "language")  # a fixed table
    return both.groupBy("role", "engagement_id").agg(F.count(F.lit(1)).alias("n"))
