"""The scanners' documents, one declaration each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.scalars import digits, line_range
from evidentia.operators.normalize.base import Tool, const, line, lines, lookup, not_negative, note, one_of, text

# Severities of tools and the CWE classes of their codes.
SEMGREP = {"ERROR": "high", "WARNING": "medium"}
LEVELS = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
ADVISORY = {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "MODERATE": "medium", "LOW": "low"}
RUFF_CWE = {"S608": "CWE-89", "S605": "CWE-78", "S606": "CWE-78", "S607": "CWE-78", "S301": "CWE-502", "S302": "CWE-502", "S324": "CWE-327"}
CLIPPY_CWE = {
    "clippy::unwrap_used": "CWE-248", "clippy::expect_used": "CWE-248", "clippy::indexing_slicing": "CWE-129", "clippy::integer_arithmetic": "CWE-190",
    "clippy::integer_overflow": "CWE-190", "clippy::cast_possible_truncation": "CWE-704", "clippy::cast_sign_loss": "CWE-704",
    "clippy::filetype_is_file": "CWE-367", "clippy::suspicious_open_options": "CWE-732",
}
ESLINT_CWE = {
    "security/detect-eval-with-expression": "CWE-95", "security/detect-non-literal-fs-filename": "CWE-22", "security/detect-non-literal-require": "CWE-95",
    "security/detect-object-injection": "CWE-471", "security/detect-possible-timing-attacks": "CWE-208", "security/detect-pseudoRandomBytes": "CWE-338",
    "security/detect-unsafe-regex": "CWE-1333", "security/detect-buffer-noassert": "CWE-120", "security/detect-child-process": "CWE-78",
    "security/detect-disable-mustache-escape": "CWE-79", "security/detect-no-csrf-before-method-override": "CWE-352",
    "security/detect-non-literal-regexp": "CWE-1333", "no-unsanitized/method": "CWE-79", "no-unsanitized/property": "CWE-79",
}
STATICCHECK_CWE = {"SA1006": "CWE-134", "SA5009": "CWE-134", "SA1031": "CWE-770"}
STATICCHECK_NONE = ["SA1019", "SA4006", "S1024", "S1028"]
TITLE = 100


def parsed(schema: str, path: str | None = None):
    """Documents as JSON of a schema; ``path`` leads to the array of items."""

    def items(raw: Column) -> Column:
        value = F.from_json(raw, schema)
        for part in (path or "").split("."):
            value = value[part] if part else value
        return value

    return items


def ndjson(schema: str):
    """Lines of JSON; lines that are none are dropped. A JSON array or a JSON string of lines will do, too."""

    def items(raw: Column) -> Column:
        whole = F.from_json(raw, f"array<{schema}>")
        inner = F.when(F.ltrim(raw).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
        each = F.filter(F.transform(lines(inner), lambda v: F.when(v.startswith("{"), F.from_json(v, schema))), lambda v: v.isNotNull())
        return F.when(F.ltrim(raw).startswith("["), whole).otherwise(each)

    return items


def _pick(array: Column, keep) -> Column:
    return F.filter(array, keep)


def _flat(array: Column, inner, each) -> Column:
    """Items of inner arrays with what ``each`` takes from the outer struct; null stays null."""
    return F.flatten(F.transform(array, lambda o: F.transform(F.coalesce(inner(o), F.array()), lambda i: each(o, i))))


SEMGREP_SCHEMA = (
    "results array<struct<check_id:string,path:string,start:struct<line:bigint>,end:struct<line:bigint>,"
    "extra:struct<severity:string,message:string,metadata:struct<cwe:array<string>,owasp:array<string>>>>>"
)
semgrep = Tool(
    "semgrep", parsed(SEMGREP_SCHEMA, "results"),
    {
        "rule_id": lambda x: text(x["check_id"]), "file_path": lambda x: text(x["path"]), "line_start": lambda x: line(x["start"]["line"]),
        "line_end": lambda x: line(x["end"]["line"], line(x["start"]["line"])), "severity": lambda x: one_of(x["extra"]["severity"], SEMGREP, "low"),
        "confidence": const("medium"), "cwe": lambda x: F.substring_index(F.get(x["extra"]["metadata"]["cwe"], 0), ":", 1),
        "owasp": lambda x: F.get(x["extra"]["metadata"]["owasp"], 0), "title": lambda x: text(x["check_id"]), "description": lambda x: text(x["extra"]["message"]),
    },
    strips_root=False,
)

bandit = Tool(
    "bandit",
    parsed(
        "results array<struct<filename:string,line_number:bigint,line_range:array<bigint>,issue_severity:string,issue_confidence:string,"
        "issue_text:string,test_id:string,test_name:string,issue_cwe:struct<id:bigint>>>", "results",
    ),
    {
        "rule_id": lambda x: text(x["test_id"]), "file_path": lambda x: text(x["filename"]),
        "line_start": lambda x: line(F.coalesce(F.get(x["line_range"], 0), x["line_number"])),
        "line_end": lambda x: line(F.coalesce(F.get(x["line_range"], F.size(x["line_range"]) - 1), x["line_number"])),
        "severity": lambda x: one_of(x["issue_severity"], LEVELS, "low"), "confidence": lambda x: one_of(x["issue_confidence"], LEVELS, "low"),
        "cwe": lambda x: F.concat(F.lit("CWE-"), x["issue_cwe"]["id"].cast("string")), "title": lambda x: F.coalesce(x["test_name"], x["test_id"], F.lit("")),
        "description": lambda x: text(x["issue_text"]),
    },
    strips_root=False,
)

ruff = Tool(
    "ruff",
    lambda raw: _pick(
        F.from_json(raw, "array<struct<code:string,filename:string,message:string,location:struct<row:bigint>,end_location:struct<row:bigint>>>"),
        lambda x: text(x["code"]).startswith("S"),
    ),
    {
        "rule_id": lambda x: x["code"], "file_path": lambda x: text(x["filename"]), "line_start": lambda x: line(x["location"]["row"]),
        "line_end": lambda x: line(x["end_location"]["row"], line(x["location"]["row"])),
        "severity": lambda x: F.when(x["code"].rlike("^S[56]"), "high").when(x["code"].rlike("^S[123]"), "medium").otherwise("low"),
        "confidence": const("medium"), "cwe": lambda x: lookup(x["code"], RUFF_CWE), "title": lambda x: x["code"], "description": lambda x: text(x["message"]),
    },
    strips_root=False,
)

pip_audit = Tool(
    "pip-audit",
    lambda raw: _flat(
        F.from_json(
            raw, "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,aliases:array<string>,fix_versions:array<string>,description:string>>>>"
        )["dependencies"],
        lambda d: d["vulns"], lambda d, v: F.struct(d["name"].alias("name"), d["version"].alias("version"), v.alias("v")),
    ),
    {
        "rule_id": lambda x: text(x["v"]["id"]), "file_path": const("requirements.txt"), "line_start": lambda x: F.lit(0), "line_end": lambda x: F.lit(0),
        "severity": const("high"), "confidence": const("high"), "owasp": lambda x: F.get(F.filter(x["v"]["aliases"], lambda a: a.startswith("CVE-")), 0),
        "title": lambda x: F.concat(text(x["name"]), F.lit(" "), text(x["version"]), F.lit(": "), text(x["v"]["id"])),
        "description": lambda x: F.concat(text(x["v"]["description"]), F.lit("\nFix versions: "), text(F.array_join(x["v"]["fix_versions"], ", "))),
    },
)

cargo_audit = Tool(
    "cargo-audit",
    parsed(
        "vulnerabilities struct<list:array<struct<advisory:struct<id:string,package:string,title:string,description:string,severity:string>,"
        "package:struct<name:string,version:string>,versions:struct<patched:array<string>>>>>", "vulnerabilities.list",
    ),
    {
        "rule_id": lambda x: text(x["advisory"]["id"]), "file_path": const("Cargo.toml"), "line_start": lambda x: F.lit(0), "line_end": lambda x: F.lit(0),
        "severity": lambda x: one_of(x["advisory"]["severity"], ADVISORY, "medium"), "confidence": const("high"),
        "title": lambda x: F.when(text(x["advisory"]["title"]) == "", text(x["advisory"]["id"])).otherwise(F.concat(text(x["advisory"]["id"]), F.lit(": "), x["advisory"]["title"])),
        "description": lambda x: F.when(text(F.array_join(x["versions"]["patched"], ", ")) == "", text(x["advisory"]["description"])).otherwise(F.concat(
            text(x["advisory"]["description"]), F.lit("\n\nPackage: "), F.coalesce(x["package"]["name"], x["advisory"]["package"], F.lit("")), F.lit(" "),
            text(x["package"]["version"]), F.lit("\nPatched: "), F.array_join(x["versions"]["patched"], ", "),
        )),
    },
)


def _clippy(raw: Column) -> Column:
    schema = (
        "struct<reason:string,message:struct<code:struct<code:string>,level:string,message:string,rendered:string,"
        "spans:array<struct<file_name:string,line_start:bigint,line_end:bigint,is_primary:boolean>>>>"
    )
    ours = lambda m: (m["reason"] == "compiler-message") & m["message"]["code"]["code"].startswith("clippy::") & m["message"]["level"].isin("error", "warning")
    span = lambda m: F.coalesce(F.get(F.filter(m["spans"], lambda s: s["is_primary"]), 0), F.get(m["spans"], 0))
    return F.transform(_pick(ndjson(schema)(raw), lambda m: F.coalesce(ours(m), F.lit(False))), lambda m: F.struct(m["message"].alias("m"), span(m["message"]).alias("s")))


clippy = Tool(
    "clippy", _clippy,
    {
        "rule_id": lambda x: x["m"]["code"]["code"], "file_path": lambda x: text(x["s"]["file_name"]), "line_start": lambda x: line(x["s"]["line_start"]),
        "line_end": lambda x: line(x["s"]["line_end"], line(x["s"]["line_start"])), "severity": lambda x: F.when(x["m"]["level"] == "error", "high").otherwise("low"),
        "confidence": const("medium"), "cwe": lambda x: lookup(x["m"]["code"]["code"], CLIPPY_CWE), "title": lambda x: F.coalesce(x["m"]["message"], x["m"]["code"]["code"]),
        "description": lambda x: F.coalesce(F.nullif(x["m"]["rendered"], F.lit("")), x["m"]["message"], x["m"]["code"]["code"]),
    },
)

eslint = Tool(
    "eslint",
    lambda raw: _pick(
        _flat(
            F.from_json(raw, "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:bigint,message:string,line:bigint,endLine:bigint>>>>"),
            lambda f: f["messages"], lambda f, m: F.struct(f["filePath"].alias("path"), m.alias("m")),
        ),
        lambda x: text(x["m"]["ruleId"]) != "",
    ),
    {
        "rule_id": lambda x: x["m"]["ruleId"], "file_path": lambda x: text(x["path"]), "line_start": lambda x: line(x["m"]["line"]),
        "line_end": lambda x: line(x["m"]["endLine"], line(x["m"]["line"])), "severity": lambda x: F.when(x["m"]["severity"] == 2, "high").otherwise("medium"),
        "confidence": const("medium"), "cwe": lambda x: lookup(x["m"]["ruleId"], ESLINT_CWE), "title": lambda x: F.coalesce(x["m"]["message"], x["m"]["ruleId"]),
        "description": const(""),
    },
)


def _npm(raw: Column) -> Column:
    # an object read as a string is its JSON text; plain strings don't begin with a brace
    entries = F.map_values(F.from_json(raw, "vulnerabilities map<string,struct<name:string,severity:string,range:string,via:array<string>>>")["vulnerabilities"])
    via = "name string, title string, url string, severity string, source string, cwe array<string>"
    objects = lambda e: F.filter(e["via"], lambda v: v.startswith("{"))
    return _flat(entries, objects, lambda e, v: F.struct(e["name"].alias("name"), e["severity"].alias("severity"), e["range"].alias("range"), F.from_json(v, via).alias("v")))


_npm_name = lambda x: F.coalesce(x["v"]["name"], x["name"], F.lit(""))
npm_audit = Tool(
    "npm-audit", _npm,
    {
        "rule_id": lambda x: F.coalesce(x["v"]["source"], _npm_name(x)), "file_path": const("package.json"), "line_start": lambda x: F.lit(0), "line_end": lambda x: F.lit(0),
        "severity": lambda x: one_of(F.coalesce(x["v"]["severity"], x["severity"]), {**ADVISORY, "INFO": "info"}, "medium"), "confidence": const("high"),
        "cwe": lambda x: F.get(x["v"]["cwe"], 0),
        "title": lambda x: F.when(text(x["v"]["title"]) == "", _npm_name(x)).otherwise(F.concat(_npm_name(x), F.lit(": "), x["v"]["title"])),
        "description": lambda x: F.concat(F.lit("via "), text(x["name"]), F.lit("@"), text(x["range"], "*"), F.lit(" ("), text(x["v"]["url"]), F.lit(")")),
    },
)

gosec = Tool(
    "gosec",
    parsed("Issues array<struct<severity:string,confidence:string,cwe:struct<ID:string>,rule_id:string,details:string,file:string,line:string>>", "Issues"),
    {
        "rule_id": lambda x: text(x["rule_id"]), "file_path": lambda x: text(x["file"]), "line_start": lambda x: line(line_range(text(x["line"]))["first"]),
        "line_end": lambda x: line(line_range(text(x["line"]))["last"]), "severity": lambda x: one_of(x["severity"], LEVELS, "medium"),
        "confidence": lambda x: one_of(x["confidence"], LEVELS, "medium"), "cwe": lambda x: F.concat(F.lit("CWE-"), F.nullif(x["cwe"]["ID"], F.lit(""))),
        "title": lambda x: F.when(text(x["details"]) == "", text(x["rule_id"])).otherwise(F.substring(x["details"], 1, TITLE)), "description": lambda x: text(x["details"]),
    },
)


def _staticcheck(raw: Column) -> Column:
    each = ndjson("struct<code:string,severity:string,location:struct<file:string,line:bigint>,end:struct<file:string,line:bigint>,message:string>")(raw)
    return _pick(each, lambda x: text(x["code"]) != "")


staticcheck = Tool(
    "staticcheck", _staticcheck,
    {
        "rule_id": lambda x: x["code"], "file_path": lambda x: text(x["location"]["file"]), "line_start": lambda x: line(x["location"]["line"]),
        "line_end": lambda x: F.when(x["end"].isNull(), line(x["location"]["line"])).otherwise(line(x["end"]["line"])),
        "severity": lambda x: F.when(x["severity"] == "error", "high").otherwise("low"), "confidence": const("medium"),
        "cwe": lambda x: F.when(x["code"].isin(STATICCHECK_NONE), None).otherwise(F.coalesce(lookup(x["code"], STATICCHECK_CWE), F.when(x["code"].startswith("SA"), "CWE-754"))),
        "title": lambda x: F.substring(F.concat(x["code"], F.lit(": "), text(x["message"])), 1, TITLE), "description": lambda x: text(x["message"]),
    },
)

_CHECKOV = (
    "array<struct<check_type:string,results:struct<failed_checks:array<struct<check_id:string,check_name:string,file_path:string,"
    "file_line_range:array<bigint>,severity:string,guideline:string>>>>>"
)
checkov = Tool(
    "checkov",
    # an array schema reads a single object as an array of one
    lambda raw: _flat(F.from_json(raw, _CHECKOV), lambda f: f["results"]["failed_checks"], lambda f, c: F.struct(text(f["check_type"], "iac").alias("kind"), c.alias("c"))),
    {
        "rule_id": lambda x: text(x["c"]["check_id"]), "file_path": lambda x: F.ltrim(text(x["c"]["file_path"]), F.lit("/")),
        "line_start": lambda x: not_negative(F.get(x["c"]["file_line_range"], 0)), "line_end": lambda x: not_negative(F.get(x["c"]["file_line_range"], 1)),
        "severity": lambda x: F.lower(text(x["c"]["severity"], "medium")), "confidence": const("high"),
        "title": lambda x: F.concat(x["kind"], F.lit(": "), text(x["c"]["check_name"])), "description": lambda x: note(text(x["c"]["check_name"]), "Guideline", x["c"]["guideline"]),
    },
    strips_root=False,
)

tfsec = Tool(
    "tfsec",
    parsed("results array<struct<rule_id:string,description:string,severity:string,resolution:string,location:struct<filename:string,start_line:bigint,end_line:bigint>>>", "results"),
    {
        "rule_id": lambda x: text(x["rule_id"]), "file_path": lambda x: F.ltrim(text(x["location"]["filename"]), F.lit("/")),
        "line_start": lambda x: not_negative(x["location"]["start_line"]), "line_end": lambda x: not_negative(x["location"]["end_line"]),
        "severity": lambda x: F.lower(text(x["severity"], "medium")), "confidence": const("high"),
        "title": lambda x: F.concat(F.lit("tfsec "), text(x["rule_id"]), F.lit(": "), text(x["description"])),
        "description": lambda x: note(text(x["description"]), "Resolution", x["resolution"]),
    },
    strips_root=False,
)


def _trivy(raw: Column) -> Column:
    """The three lists of a target, brought to one struct type."""
    schema = (
        "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,"
        "Title:string,Severity:string,Description:string,CweIDs:array<string>>>,Misconfigurations:array<struct<ID:string,Title:string,Severity:string,"
        "Message:string,Resolution:string,CauseMetadata:struct<StartLine:bigint,EndLine:bigint>>>,Secrets:array<struct<Category:string,Title:string,"
        "RuleID:string,Severity:string,StartLine:bigint,EndLine:bigint,Match:string>>>>"
    )

    def row(target, rule, first, last, severity, cwe, owasp, title, description) -> Column:
        none = F.lit(None).cast("string")
        values = [text(target), rule, not_negative(first), not_negative(last), severity, none if cwe is None else cwe, none if owasp is None else owasp, title, description]
        return F.struct(*(v.alias(n) for v, n in zip(values, ["file", "rule", "first", "last", "severity", "cwe", "owasp", "title", "description"])))

    def vulnerability(t: Column, v: Column) -> Column:
        rule, package = text(v["VulnerabilityID"]), F.concat(text(v["PkgName"]), F.lit(" "), text(v["InstalledVersion"]))
        title = F.when(text(v["Title"]) == "", F.concat(F.lit("trivy "), rule, F.lit(" ("), package, F.lit(")"))).otherwise(F.concat(rule, F.lit(": "), v["Title"]))
        body = F.concat(F.lit("Package: "), package, F.lit("\nFix: "), text(v["FixedVersion"], "(none)"), F.lit("\n\n"), text(v["Description"]))
        return row(t, rule, F.lit(0), F.lit(0), F.lower(text(v["Severity"], "medium")), F.get(F.filter(v["CweIDs"], lambda c: c.isNotNull()), 0), rule, title, body)

    def misconfiguration(t: Column, m: Column) -> Column:
        at = m["CauseMetadata"]
        return row(
            t, text(m["ID"]), at["StartLine"], at["EndLine"], F.lower(text(m["Severity"], "medium")), None, None,
            F.concat(text(m["ID"]), F.lit(": "), text(m["Title"])), note(text(m["Message"]), "Resolution", m["Resolution"]),
        )

    def secret(t: Column, s: Column) -> Column:
        title = F.concat(F.lit("Secret leak ("), text(s["Category"]), F.lit("): "), text(s["Title"]))
        body = F.concat(F.lit("Rule: "), text(s["RuleID"]), F.lit("\nMatch (redacted): "), text(s["Match"]))
        return row(t, text(s["RuleID"]), s["StartLine"], s["EndLine"], F.lower(text(s["Severity"], "critical")), F.lit("CWE-798"), None, title, body)

    def target(r: Column) -> Column:
        part = lambda name, make: F.transform(F.coalesce(r[name], F.array()), lambda i: make(r["Target"], i))
        return F.concat(part("Vulnerabilities", vulnerability), part("Misconfigurations", misconfiguration), part("Secrets", secret))

    return F.flatten(F.transform(F.from_json(raw, schema)["Results"], target))


trivy = Tool(
    "trivy", _trivy,
    {
        "rule_id": lambda x: x["rule"], "file_path": lambda x: x["file"], "line_start": lambda x: x["first"], "line_end": lambda x: x["last"],
        "severity": lambda x: x["severity"], "confidence": const("high"), "cwe": lambda x: x["cwe"], "owasp": lambda x: x["owasp"],
        "title": lambda x: x["title"], "description": lambda x: x["description"],
    },
    strips_root=False,
)

_progpilot_rule = lambda x: F.when(text(x["vuln_name"]) == "", "taint").otherwise(x["vuln_name"])
progpilot = Tool(
    "progpilot", parsed("array<struct<sink_name:string,sink_file:string,sink_line:bigint,vuln_name:string,vuln_cwe:string,source_name:array<string>>>"),
    {
        "rule_id": _progpilot_rule, "file_path": lambda x: text(x["sink_file"]), "line_start": lambda x: line(x["sink_line"]), "line_end": lambda x: line(x["sink_line"]),
        "severity": const("high"), "confidence": const("medium"), "cwe": lambda x: F.concat(F.lit("CWE-"), F.nullif(digits(x["vuln_cwe"]), F.lit(""))),
        "title": lambda x: F.concat(F.lit("Progpilot: "), _progpilot_rule(x)),
        "description": lambda x: F.concat(
            F.lit("Tainted data from "), F.coalesce(F.nullif(F.array_join(x["source_name"], ", "), F.lit("")), F.lit("tainted input")),
            F.lit(" reaches sink "), text(x["sink_name"]), F.lit("."),
        ),
    },
)

HIT = r"^\s*\[([^\]]+)\]\s+(.+)@([^\s]+)\s+\(([^)]+)\)\s*$"


def _compromised(raw: Column) -> Column:
    hits = F.filter(F.split(raw, "\r?\n"), lambda v: v.rlike(HIT))
    part = lambda v, i: F.trim(F.regexp_extract(v, HIT, i))
    return F.transform(hits, lambda v: F.struct(part(v, 1).alias("eco"), part(v, 2).alias("pkg"), part(v, 3).alias("ver"), F.regexp_extract(v, HIT, 4).alias("path")))


_package = lambda x: F.concat(x["eco"], F.lit("/"), x["pkg"], F.lit("@"), x["ver"])
compromised_packages = Tool(
    "compromised-packages-check", _compromised,
    {
        "rule_id": lambda x: F.concat(F.lit("compromised:"), _package(x)), "file_path": lambda x: x["path"], "line_start": lambda x: F.lit(0), "line_end": lambda x: F.lit(0),
        "severity": const("critical"), "confidence": const("high"), "cwe": const("CWE-506"), "title": lambda x: F.concat(F.lit("Known-malicious package: "), _package(x)),
        "description": lambda x: F.concat(
            F.lit("The "), x["eco"], F.lit(" package `"), x["pkg"], F.lit("` at version `"), x["ver"],
            F.lit("` is on a list of packages that were compromised. Treat what was built from it as suspect, and rebuild from an earlier version."),
        ),
    },
    strips_root=False,
)
