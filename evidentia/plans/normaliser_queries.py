"""Scanner normalisers over documents rendered from the events table.

Documents are JSON text, one for each user and tool; the SQL twins say what
their findings are without a detour through JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.normalize import NORMALISERS, suppress_lit
from evidentia.operators.normalize.base import COLUMNS
from evidentia.plans.audit_queries import query, table

PATH = "'/repo/src/u' || CAST(user_id AS VARCHAR) || '.py'"
SHORT = "'src/u' || CAST(user_id AS VARCHAR) || '.py'"
LINE = "CAST(event_id % 300 AS INT)"


def _events(spark, d) -> DataFrame:
    path = F.concat(F.lit("/repo/src/u"), F.col("user_id").cast("string"), F.lit(".py"))
    return table(spark, d, "events").withColumn("path", path).withColumn("line", F.col("event_id") % 300)


def _docs(rows: DataFrame, item: Column, wrap: str | None = None, by: str = "user_id", join: str | None = None) -> DataFrame:
    """One document a user: the items as a JSON array, an object around it, or lines."""
    items = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("i")))), lambda x: x["i"]).alias("a"))
    if join is not None:
        raw = F.array_join(F.transform("a", lambda i: F.to_json(i)), join)
    else:
        raw = F.to_json(F.struct(F.col("a").alias(wrap)) if wrap else F.col("a"))
    return items.select(by, raw.alias("raw"))


def _found(df: DataFrame) -> DataFrame:
    return df.select("user_id", *COLUMNS)


def _sql(tool: str, rule: str, path: str, first: str, last: str, severity: str, confidence: str, cwe: str, owasp: str, title: str, description: str, source: str = "events") -> str:
    values = [f"'{tool}'", rule, path, first, last, severity, confidence, cwe, owasp, title, description]
    return "SELECT user_id, " + ", ".join(f"{v} AS {c}" for v, c in zip(values, COLUMNS)) + f" FROM {source}"


@query(_sql("semgrep", "event_type", PATH, LINE, f"{LINE} + 1", "CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END", "'medium'", "'CWE-' || CAST(event_id % 50 AS VARCHAR)", "CASE WHEN event_id % 2 = 0 THEN 'A03' END", "event_type", "props"))
def normalise_semgrep(spark, d):
    e, cwe = _events(spark, d), F.array(F.concat(F.lit("CWE-"), (F.col("event_id") % 50).cast("string"), F.lit(": name")))
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "warning").otherwise("odd")
    owasp = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("A03")))
    extra = F.struct(severity.alias("severity"), F.col("props").alias("message"), F.struct(cwe.alias("cwe"), owasp.alias("owasp")).alias("metadata"))
    item = F.struct(F.col("event_type").alias("check_id"), "path", F.struct("line").alias("start"), F.struct((F.col("line") + 1).alias("line")).alias("end"), extra.alias("extra"))
    return _found(NORMALISERS["semgrep"](_docs(e, item, "results")))


@query(_sql("bandit", "'B' || CAST(event_id % 9 AS VARCHAR)", PATH, LINE, f"CASE WHEN event_id % 2 = 0 THEN {LINE} + 2 ELSE {LINE} END", "CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END", "'medium'", "'CWE-' || CAST(event_id % 50 AS VARCHAR)", "NULL", "event_type", "props"))
def normalise_bandit(spark, d):
    level = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "click", "Medium").otherwise("UNDEFINED")
    lines = F.when(F.col("event_id") % 2 == 0, F.array("line", F.col("line") + 1, F.col("line") + 2))
    item = F.struct(F.col("path").alias("filename"), F.col("line").alias("line_number"), lines.alias("line_range"), level.alias("issue_severity"), F.lit("MEDIUM").alias("issue_confidence"), F.col("props").alias("issue_text"), F.concat(F.lit("B"), (F.col("event_id") % 9).cast("string")).alias("test_id"), F.col("event_type").alias("test_name"), F.struct((F.col("event_id") % 50).alias("id")).alias("issue_cwe"))
    return _found(NORMALISERS["bandit"](_docs(_events(spark, d), item, "results")))


_RUFF = "CASE event_id % 5 WHEN 0 THEN 'S608' WHEN 1 THEN 'S301' WHEN 2 THEN 'E501' WHEN 3 THEN 'S113' ELSE 'S7' END"


@query(_sql("ruff", "r", PATH, LINE, LINE, "CASE WHEN r = 'S608' THEN 'high' WHEN r = 'S7' THEN 'low' ELSE 'medium' END", "'medium'", "CASE r WHEN 'S608' THEN 'CWE-89' WHEN 'S301' THEN 'CWE-502' END", "NULL", "r", "props", f"(SELECT *, {_RUFF} AS r FROM events) WHERE r <> 'E501'"))
def normalise_ruff(spark, d):
    item = F.struct(F.expr(_RUFF).alias("code"), F.col("path").alias("filename"), F.col("props").alias("message"), F.struct(F.col("line").alias("row")).alias("location"))
    return _found(NORMALISERS["ruff"](_docs(_events(spark, d), item)))


@query(_sql("checkov", "'CKV_' || CAST(event_id % 40 AS VARCHAR)", f"substr({PATH}, 2)", LINE, "0", "CASE WHEN event_id % 3 = 0 THEN 'medium' ELSE 'high' END", "'high'", "NULL", "NULL", "'terraform: ' || event_type", "event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'Guideline: ' || props ELSE '' END"))
def normalise_checkov(spark, d):
    item = F.struct(F.concat(F.lit("CKV_"), (F.col("event_id") % 40).cast("string")).alias("check_id"), F.col("event_type").alias("check_name"), F.col("path").alias("file_path"), F.array("line").alias("file_line_range"), F.when(F.col("event_id") % 3 != 0, "HIGH").alias("severity"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("guideline"))
    docs = _docs(_events(spark, d), item)
    body = F.concat(F.lit('{"check_type":"terraform","results":{"failed_checks":'), "raw", F.lit("}}"))
    return _found(NORMALISERS["checkov"](docs.withColumn("raw", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body))))


@query(f"""WITH t AS (SELECT user_id, event_id, event_type, props, CAST(event_id % 300 AS INT) AS l FROM events)
SELECT user_id, 'trivy' AS tool, 'V' || CAST(event_id AS VARCHAR) AS rule_id, event_type AS file_path, 0 AS line_start, 0 AS line_end, 'low' AS severity, 'high' AS confidence, 'CWE-7' AS cwe, 'V' || CAST(event_id AS VARCHAR) AS owasp,
  'V' || CAST(event_id AS VARCHAR) || ': ' || event_type AS title, 'Package: p 1' || chr(10) || 'Fix: (none)' || chr(10) || chr(10) || props AS description FROM t WHERE event_id % 3 = 0
UNION ALL SELECT user_id, 'trivy', 'M' || CAST(event_id AS VARCHAR), event_type, l, l, 'medium', 'high', NULL, NULL, 'M' || CAST(event_id AS VARCHAR) || ': ' || event_type, props FROM t WHERE event_id % 3 = 1
UNION ALL SELECT user_id, 'trivy', 'K' || CAST(event_id AS VARCHAR), event_type, l, l, 'critical', 'high', 'CWE-798', NULL, 'Secret leak (aws): ' || event_type, 'Rule: K' || CAST(event_id AS VARCHAR) || chr(10) || 'Match (redacted): ' || props FROM t WHERE event_id % 3 = 2""")  # fmt: skip
def array_union_sources(spark, d):
    """Three lists of one document, brought together."""
    e, n = _events(spark, d), F.col("event_id").cast("string")
    vulnerability = F.struct(F.concat(F.lit("V"), n).alias("VulnerabilityID"), F.lit("p").alias("PkgName"), F.lit("1").alias("InstalledVersion"), F.col("event_type").alias("Title"), F.lit("LOW").alias("Severity"), F.col("props").alias("Description"), F.array(F.lit("CWE-7")).alias("CweIDs"))
    misconfiguration = F.struct(F.concat(F.lit("M"), n).alias("ID"), F.col("event_type").alias("Title"), F.col("props").alias("Message"), F.struct(F.col("line").alias("StartLine"), F.col("line").alias("EndLine")).alias("CauseMetadata"))
    secret = F.struct(F.lit("aws").alias("Category"), F.col("event_type").alias("Title"), F.concat(F.lit("K"), n).alias("RuleID"), F.col("line").alias("StartLine"), F.col("line").alias("EndLine"), F.col("props").alias("Match"))
    part = lambda k, s: F.collect_list(F.when(F.col("event_id") % 3 == k, s))
    targets = e.groupBy("user_id", "event_type").agg(part(0, vulnerability).alias("Vulnerabilities"), part(1, misconfiguration).alias("Misconfigurations"), part(2, secret).alias("Secrets"))
    target = F.struct(F.col("event_type").alias("Target"), *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("Vulnerabilities", "Misconfigurations", "Secrets")))
    docs = targets.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(target).alias("Results"))).alias("raw"))
    return _found(NORMALISERS["trivy"](docs))


@query(_sql("npm-audit", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END", "'package.json'", "0", "0", "CASE WHEN event_id % 5 = 0 THEN 'high' ELSE 'medium' END", "'high'", "'CWE-1'", "NULL", "event_type || ': ' || props", "'via p' || CAST(event_id AS VARCHAR) || '@* (u)'", "events WHERE event_type <> 'view'"))
def map_explode(spark, d):
    """Entries of a map whose lists mix strings and objects; strings are skipped."""
    n = F.col("event_id").cast("string")
    source = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    via = F.to_json(F.struct(source.alias("source"), F.col("event_type").alias("name"), F.col("props").alias("title"), F.lit("u").alias("url"), F.array(F.lit("CWE-1")).alias("cwe")))
    severity = F.when(F.col("event_id") % 5 == 0, "high").otherwise("moderate")
    entry = F.concat(F.lit('"k'), n, F.lit('":{"name":"p'), n, F.lit('","severity":"'), severity, F.lit('","via":["other"'), F.when(F.col("event_type") != "view", F.concat(F.lit(","), via)).otherwise(""), F.lit("]}"))
    docs = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit('{"vulnerabilities":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("raw"))
    return _found(NORMALISERS["npm_audit"](docs))


@query(_sql("govulncheck", "'GO-' || event_type", f"CASE WHEN event_id % 4 = 0 THEN 'go.mod' ELSE {SHORT} END", f"CASE WHEN event_id % 4 = 0 THEN 0 ELSE {LINE} END", f"CASE WHEN event_id % 4 = 0 THEN 0 ELSE {LINE} END", "CASE WHEN event_id % 4 = 0 THEN 'medium' ELSE 'high' END", "'high'", "'CWE-2'", "NULL", "'GO-' || event_type || ': sum'", "'sum'", "events WHERE event_type <> 'view'"))
def osv_join(spark, d):
    """Two kinds of records of one stream, joined on the advisory."""
    e = _events(spark, d)
    osv = F.concat(F.lit("GO-"), "event_type")
    frame = F.struct(F.struct(F.col("path").alias("filename"), "line").alias("position"))
    trace = F.when(F.col("event_id") % 4 != 0, F.array(frame)).otherwise(F.array().cast("array<struct<position:struct<filename:string,line:bigint>>>"))
    docs = _docs(e, F.struct(F.struct(osv.alias("osv"), trace.alias("trace")).alias("finding")), join="\n")
    advisories = "".join('{"osv":{"id":"GO-%s","summary":"%s","aliases":["CVE-1","CWE-2"]}}\n' % (k, s) for s in ("old", "sum") for k in ("click", "signup", "purchase", "error"))
    return _found(NORMALISERS["govulncheck"](docs.withColumn("raw", F.concat(F.lit(advisories + "not json\n"), "raw"))))


@query(_sql("staticcheck", "r", SHORT, LINE, LINE, "CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END", "'medium'", "CASE r WHEN 'SA1006' THEN 'CWE-134' WHEN 'SA9' THEN 'CWE-754' END", "NULL", "substr(r || ': ' || props || props || props || props || props || props || props || props || props || props || props || props, 1, 100)", "props || props || props || props || props || props || props || props || props || props || props || props", "(SELECT *, CASE event_id % 4 WHEN 0 THEN 'SA1006' WHEN 1 THEN 'SA9' WHEN 2 THEN 'SA1019' ELSE '' END AS r FROM events) WHERE r <> ''"))
def normalise_staticcheck(spark, d):
    code = F.expr("CASE event_id % 4 WHEN 0 THEN 'SA1006' WHEN 1 THEN 'SA9' WHEN 2 THEN 'SA1019' ELSE '' END")
    item = F.struct(code.alias("code"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), F.struct(F.col("path").alias("file"), "line").alias("location"), F.repeat("props", 12).alias("message"))
    return _found(NORMALISERS["staticcheck"](_docs(_events(spark, d), item, join="\n")))


@query(_sql("gosec", "'G' || CAST(event_id % 9 AS VARCHAR)", SHORT, LINE, f"CASE WHEN event_id % 2 = 0 THEN {LINE} + 3 ELSE {LINE} END", "CASE event_type WHEN 'error' THEN 'high' ELSE 'medium' END", "'low'", "CASE WHEN event_id % 3 = 0 THEN 'CWE-5' END", "NULL", "props", "props"))
def normalise_gosec(spark, d):
    span = F.concat(F.col("line").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("-"), (F.col("line") + 3).cast("string"))).otherwise(""))
    item = F.struct(F.when(F.col("event_type") == "error", "HIGH").otherwise("?").alias("severity"), F.lit("low").alias("confidence"), F.struct(F.when(F.col("event_id") % 3 == 0, "5").otherwise("").alias("ID")).alias("cwe"), F.concat(F.lit("G"), (F.col("event_id") % 9).cast("string")).alias("rule_id"), F.col("props").alias("details"), F.col("path").alias("file"), span.alias("line"))
    return _found(NORMALISERS["gosec"](_docs(_events(spark, d), item, "Issues")))


@query(_sql("eslint", "'no-unsanitized/method'", SHORT, LINE, LINE, "CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END", "'medium'", "'CWE-79'", "NULL", "props", "''", "events WHERE event_id % 3 <> 0"))
def normalise_eslint(spark, d):
    message = F.struct(F.when(F.col("event_id") % 3 != 0, "no-unsanitized/method").alias("ruleId"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("severity"), F.col("props").alias("message"), "line")
    files = _events(spark, d).groupBy("user_id", F.col("path").alias("filePath")).agg(F.collect_list(message).alias("messages"))
    return _found(NORMALISERS["eslint"](files.select("user_id", F.to_json(F.array(F.struct("filePath", "messages"))).alias("raw"))))


@query(_sql("compromised-packages-check", "'compromised:npm/@s/' || event_type || '@' || CAST(event_id AS VARCHAR)", "'lock'", "0", "0", "'critical'", "'high'", "'CWE-506'", "NULL", "'Known-malicious package: npm/@s/' || event_type || '@' || CAST(event_id AS VARCHAR)", "'The npm package `@s/' || event_type || '` at version `' || CAST(event_id AS VARCHAR) || '` is on a list of packages that were compromised. Treat what was built from it as suspect, and rebuild from an earlier version.'"))
def normalise_compromised_packages(spark, d):
    hit = F.concat(F.lit("  [npm] @s/"), "event_type", F.lit("@"), F.col("event_id").cast("string"), F.lit("  (lock)"))
    docs = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("Scanning ...\n"), F.array_join(F.collect_list(hit), "\n")).alias("raw"))
    return _found(NORMALISERS["compromised_packages"](docs))


@query("SELECT event_type, count(*) AS kept FROM events WHERE NOT (event_type = 'click' AND user_id % 2 = 0) GROUP BY event_type")
def suppress_jquery(spark, d):
    e = table(spark, d, "events")
    files = e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("user_id") % 2 == 0, "import {html} from 'lit'\n").otherwise("import {html} from 'lit'\nimport $ from 'jquery'").alias("text")).distinct()
    rules = F.when(F.col("event_type") == "click", "javascript.jquery.security").otherwise("other")
    found = e.select(F.lit("semgrep").alias("tool"), "event_type", rules.alias("rule_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_path"))
    return suppress_lit(found, files)[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


