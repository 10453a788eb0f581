"""Scanner normalisers by tool name, and the run that puts them together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.operators.normalize import govulncheck, tools
from evidentia.scratch import Scratch

TOOLS: dict[str, tools.Tool] = {
    "semgrep": tools.semgrep, "semgrep_rust": tools.semgrep, "semgrep_ts": tools.semgrep, "bandit": tools.bandit, "ruff": tools.ruff,
    "pip_audit": tools.pip_audit, "cargo_audit": tools.cargo_audit, "clippy": tools.clippy, "eslint": tools.eslint, "npm_audit": tools.npm_audit,
    "gosec": tools.gosec, "staticcheck": tools.staticcheck, "checkov": tools.checkov, "tfsec": tools.tfsec, "trivy": tools.trivy,
    "progpilot": tools.progpilot, "compromised_packages": tools.compromised_packages,
}

#: Tool name -> documents to findings.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {n: t.findings for n, t in TOOLS.items()} | {"govulncheck": govulncheck.findings}


def register(name: str, normaliser: Callable[[DataFrame], DataFrame]) -> None:
    """Add a normaliser: documents (``raw`` and keys) to keys, ``ordinal`` and the eleven columns."""
    NORMALISERS[name] = normaliser


def normalise(docs: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Findings of documents of all tools: ``docs`` has ``tool_name``, ``raw`` and keys.

    Documents are read once and dealt to folders by tool, so that each
    normaliser reads those of its tool alone; there is no shuffle. Documents of
    unknown tools, or of none, give no findings."""
    scratch = Scratch(docs.sparkSession, "documents")
    docs.where(F.col(tool).isin(*NORMALISERS)).write.partitionBy(tool).parquet(f"{scratch.root}/by_tool")
    rest = [f.name for f in docs.schema if f.name != tool]
    schema = StructType([docs.schema[c] for c in rest] + [docs.schema[tool]])
    dealt = docs.sparkSession.read.schema(schema).parquet(f"{scratch.root}/by_tool").select(*docs.columns)
    parts = [f(dealt.where(F.col(tool) == n)) for n, f in NORMALISERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The rule family that is suppressed, and the imports that decide.
JQUERY_RULE = ".jquery."
LIT = r"(?m)^\s*import\b[^;\n]*\bfrom\s*['\"]lit(-html|-element|/[^'\"]*)?['\"]|^\s*import\s*['\"]lit(-html|/[^'\"]*)?['\"]"
JQUERY = r"\bfrom\s*['\"]jquery['\"]|\brequire\(\s*['\"]jquery['\"]\s*\)|\bimport\s*['\"]jquery['\"]"


def suppress_lit(findings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of the jQuery rules in files (``path``, ``text``) that import Lit and
    not jQuery go; the second table counts them by tool."""
    flagged = files.where(F.col("text").rlike(LIT) & ~F.col("text").rlike(JQUERY)).select(F.col("path").alias("_p"))
    hit = (F.col("file_path") == F.col("_p")) & F.col("rule_id").contains(JQUERY_RULE)
    kept = findings.join(flagged, hit, "left_anti")
    gone = findings.join(flagged, hit, "left_semi").groupBy("tool").agg(F.count(F.lit(1)).alias("suppressed"))
    return kept, gone


# Exit codes that are no failure, by tool.
SUCCESS_CODES = {"govulncheck": [0, 1, 3]}
SUCCESS_DEFAULT = [0, 1]


def responses(captured: DataFrame) -> DataFrame:
    """Captured runner responses (tool, ok, exit_code, stdout, stderr, raw_json, error) with ``usable``:
    findings make some tools exit with a code that is no failure."""
    fine = F.col("exit_code").isin(SUCCESS_DEFAULT)
    for tool, codes in SUCCESS_CODES.items():
        fine = F.when(F.col("tool") == tool, F.col("exit_code").isin(codes)).otherwise(fine)
    body = F.coalesce("raw_json", F.nullif("stdout", F.lit("")))
    return captured.withColumn("usable", F.coalesce("ok", F.lit(False)) | (F.coalesce(fine, F.lit(False)) & F.col("error").isNull() & body.isNotNull())).withColumn("raw", body)
