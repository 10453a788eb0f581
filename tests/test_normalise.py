import json

from evidentia.operators.normalize import NORMALISERS, TOOLS, normalise, responses

KEYS = ["rule_id", "file_path", "line_start", "line_end", "severity", "cwe", "title", "description"]


def run(spark, tool, raw, *columns):
    docs = spark.createDataFrame([(1, raw if isinstance(raw, str) else json.dumps(raw))], "doc int, raw string")
    return [tuple(r[c] for c in columns or KEYS) for r in NORMALISERS[tool](docs).orderBy("ordinal").collect()]


def test_semgrep_defaults(spark):
    raw = {"results": [{"path": "a.py"}, {"check_id": "r", "path": "b.py", "start": {"line": 3}, "extra": {"severity": "Error", "metadata": {"cwe": ["CWE-89: x"], "owasp": []}}}]}
    assert run(spark, "semgrep", raw, "rule_id", "line_start", "line_end", "severity", "cwe", "owasp") == [("", 0, 0, "low", None, None), ("r", 3, 3, "high", "CWE-89", None)]


def test_missing_container_is_an_error(spark):
    docs = spark.createDataFrame([(1, "{}"), (2, '{"results": []}'), (3, "nonsense")], "doc int, raw string")
    assert TOOLS["semgrep"].findings(docs).count() == 0
    assert sorted(r.doc for r in TOOLS["semgrep"].errors(docs).collect()) == [1, 3]


def test_pip_audit_nested(spark):
    raw = {"dependencies": [{"name": "a", "version": "1"}, {"name": "b", "version": "2", "vulns": [{"id": "P-1", "aliases": ["X", "CVE-9"], "fix_versions": ["3", "4"], "description": "d"}]}]}
    assert run(spark, "pip_audit", raw, "file_path", "owasp", "title", "description") == [("requirements.txt", "CVE-9", "b 2: P-1", "d\nFix versions: 3, 4")]


def test_cargo_audit(spark):
    raw = {"vulnerabilities": {"list": [{"advisory": {"id": "R1", "title": "t", "description": "d", "package": "p"}, "versions": {"patched": [">1"]}}, {"advisory": {"id": "R2", "severity": "moderate"}}]}}
    got = run(spark, "cargo_audit", raw, "severity", "title", "description")
    assert got == [("medium", "R1: t", "d\n\nPackage: p \nPatched: >1"), ("medium", "R2", "")]


def test_clippy_lines_string_or_array(spark):
    hit = {"reason": "compiler-message", "message": {"code": {"code": "clippy::unwrap_used"}, "level": "error", "message": "m", "spans": [{"file_name": "x", "line_start": 1, "line_end": 1, "is_primary": False}, {"file_name": "/repo/src/a.rs", "line_start": 4, "line_end": 5, "is_primary": True}]}}
    lines = "\n".join([json.dumps(hit), "bad", json.dumps({"reason": "other"}), json.dumps(hit | {"message": hit["message"] | {"level": "note"}}), json.dumps(hit | {"message": hit["message"] | {"code": {"code": "E1"}}})])
    want = [("clippy::unwrap_used", "src/a.rs", 4, 5, "high", "CWE-248", "m", "m")]
    assert run(spark, "clippy", lines) == want == run(spark, "clippy", [hit]) == run(spark, "clippy", json.dumps(lines))


def test_eslint_npm_gosec(spark):
    assert run(spark, "eslint", [{"filePath": "/repo/a.js", "messages": [{"ruleId": None}, {"ruleId": "security/detect-unsafe-regex", "line": 2}]}]) == [
        ("security/detect-unsafe-regex", "a.js", 2, 2, "medium", "CWE-1333", "security/detect-unsafe-regex", "")
    ]
    npm = {"vulnerabilities": {"p": {"name": "p", "severity": "high", "via": ["q", {"source": 7, "name": "q", "title": "t", "url": "u", "cwe": ["CWE-1"]}]}, "r": {"name": "r", "via": ["s"]}}}
    assert run(spark, "npm_audit", npm) == [("7", "package.json", 0, 0, "high", "CWE-1", "q: t", "via p@* (u)")]
    assert run(spark, "gosec", {"Issues": [{"rule_id": "G1", "line": "42-44", "file": "/repo/m.go", "details": "x" * 150, "cwe": {"ID": "22"}}]}, "line_start", "line_end", "cwe", "title", "severity") == [(42, 44, "CWE-22", "x" * 100, "medium")]


def test_govulncheck_join(spark):
    lines = [{"osv": {"id": "G1", "summary": "old"}}, {"finding": {"osv": "G1", "trace": [{"position": {"filename": "/repo/a.go", "line": 3}}]}}, {"finding": {"osv": "G1"}}, {"finding": {"osv": "G9"}}, {"osv": {"id": "G1", "summary": "new", "aliases": ["CVE-1", "CWE-7"]}}]
    got = run(spark, "govulncheck", "\n".join(map(json.dumps, lines)), "file_path", "line_start", "severity", "cwe", "title")
    assert got == [("a.go", 3, "high", "CWE-7", "G1: new"), ("go.mod", 0, "medium", "CWE-7", "G1: new")]


def test_checkov_shapes_trivy_tfsec_progpilot(spark):
    fail = {"check_type": "dockerfile", "results": {"failed_checks": [{"check_id": "C1", "check_name": "n", "file_path": "//Dockerfile", "file_line_range": [1, 2], "severity": None}]}}
    want = [("C1", "Dockerfile", 1, 2, "medium", None, "dockerfile: n", "n")]
    assert run(spark, "checkov", fail) == want == run(spark, "checkov", [fail, {"check_type": "x"}])
    trivy = {"Results": [{"Target": "t"}, {"Target": "f", "Secrets": [{"RuleID": "k", "StartLine": 2, "EndLine": 2, "Category": "AWS", "Title": "key", "Match": "***"}], "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1"}]}]}
    got = run(spark, "trivy", trivy, "rule_id", "severity", "cwe", "owasp", "title")
    assert got == [("CVE-1", "medium", None, "CVE-1", "trivy CVE-1 (p 1)"), ("k", "critical", "CWE-798", None, "Secret leak (AWS): key")]
    assert run(spark, "tfsec", {"results": [{"rule_id": "r", "description": "d", "resolution": "fix"}]}, "title", "description", "line_start") == [("tfsec r: d", "d\n\nResolution: fix", 0)]
    assert run(spark, "progpilot", [{"sink_name": "echo", "sink_file": "/repo/i.php", "sink_line": 3, "vuln_cwe": "CWE_89", "source_name": []}]) == [
        ("taint", "i.php", 3, 3, "high", "CWE-89", "Progpilot: taint", "Tainted data from tainted input reaches sink echo.")
    ]


def test_compromised_packages_scoped_names(spark):
    got = run(spark, "compromised_packages", "Scanning ...\n  [npm] @scope/pkg@1.2.3  (a/package-lock.json)\nnoise", "rule_id", "file_path", "severity")
    assert got == [("compromised:npm/@scope/pkg@1.2.3", "a/package-lock.json", "critical")]


def test_all_tools_together_and_responses(spark):
    docs = spark.createDataFrame([("e", "ruff", '[{"code":"S608","filename":"a"},{"code":"E1"}]'), ("e", "tfsec", '{"results":[{}]}')], "engagement_id string, tool_name string, raw string")
    assert sorted((r.tool, r.rule_id) for r in normalise(docs).collect()) == [("ruff", "S608"), ("tfsec", "")]
    rows = [("govulncheck", False, 3, "x", None), ("bandit", False, 1, "x", None), ("bandit", False, 2, "x", None), ("bandit", False, 1, "x", "boom"), ("ruff", True, 0, "", None)]
    got = responses(spark.createDataFrame([(*r, None) for r in rows], "tool string, ok boolean, exit_code int, stdout string, error string, raw_json string")).collect()
    assert [r.usable for r in got] == [True, True, False, False, True]
