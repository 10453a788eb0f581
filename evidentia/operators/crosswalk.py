"""Findings to compliance controls, by CWE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.scalars import risk_priority

# CWE, title and its controls in NIST 800-53, OWASP ASVS, SOC 2 and ISO 27001.
CONTROLS = [
    ("CWE-89", "SQL Injection", ["SI-10", "SI-15"], ["V5.3.4", "V5.3.5"], ["CC6.1", "CC8.1"], ["A.8.28", "A.8.26"]),
    ("CWE-78", "OS Command Injection", ["SI-10", "CM-7"], ["V5.3.8"], ["CC6.1", "CC6.8"], ["A.8.28"]),
    ("CWE-22", "Path Traversal", ["AC-3", "SI-10"], ["V12.3.1", "V5.1.4"], ["CC6.1"], ["A.8.28", "A.5.15"]),
    ("CWE-94", "Code Injection", ["SI-10", "CM-7"], ["V5.2.4"], ["CC6.1", "CC8.1"], ["A.8.28"]),
    ("CWE-79", "Cross-Site Scripting", ["SI-10"], ["V5.3.3"], ["CC6.1"], ["A.8.28"]),
    ("CWE-74", "Injection (generic)", ["SI-10"], ["V5.2.1"], ["CC6.1"], ["A.8.28"]),
    ("CWE-285", "Improper Authorization", ["AC-3", "AC-6"], ["V4.1.1", "V4.2.1"], ["CC6.1", "CC6.3"], ["A.5.15", "A.8.3"]),
    ("CWE-862", "Missing Authorization", ["AC-3"], ["V4.1.1"], ["CC6.1", "CC6.3"], ["A.5.15", "A.8.3"]),
    ("CWE-863", "Incorrect Authorization", ["AC-3", "AC-6"], ["V4.1.3"], ["CC6.1", "CC6.3"], ["A.5.15", "A.8.3"]),
    ("CWE-639", "Authorization Bypass (IDOR)", ["AC-3", "AC-4"], ["V4.2.1"], ["CC6.1", "CC6.3"], ["A.8.3", "A.5.15"]),
    ("CWE-918", "Server-Side Request Forgery", ["SC-7", "SI-10"], ["V5.2.6", "V12.6.1"], ["CC6.6"], ["A.8.23", "A.8.28"]),
    ("CWE-352", "Cross-Site Request Forgery", ["SC-23", "AC-4"], ["V4.2.2"], ["CC6.1"], ["A.8.28"]),
    ("CWE-400", "Uncontrolled Resource Consumption", ["SC-5"], ["V11.1.4"], ["A1.1", "CC7.2"], ["A.8.6"]),
    ("CWE-20", "Improper Input Validation", ["SI-10"], ["V5.1.3"], ["CC6.1"], ["A.8.28"]),
    ("CWE-295", "Improper Certificate Validation", ["SC-8", "SC-23"], ["V9.2.1"], ["CC6.7"], ["A.8.24", "A.5.14"]),
    ("CWE-200", "Sensitive Information Exposure", ["AC-3", "SC-8"], ["V8.1.1"], ["CC6.1", "CC6.7"], ["A.8.3", "A.5.14"]),
    ("CWE-798", "Hard-coded Credentials", ["IA-5"], ["V2.10.4", "V6.4.1"], ["CC6.1"], ["A.5.17", "A.8.5"]),
    ("CWE-732", "Incorrect Permission Assignment", ["AC-6", "AC-3"], ["V4.1.3"], ["CC6.1", "CC6.3"], ["A.8.3"]),
    ("CWE-327", "Broken/Risky Crypto Algorithm", ["SC-13"], ["V6.2.1"], ["CC6.7"], ["A.8.24"]),
    ("CWE-502", "Deserialization of Untrusted Data", ["SI-10"], ["V5.5.1"], ["CC6.1"], ["A.8.28"]),
]
FRAMEWORKS = ["nist_800_53", "owasp_asvs", "soc2", "iso_27001"]


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROLS, "cwe string, cwe_title string, " + ", ".join(f"{f} array<string>" for f in FRAMEWORKS))


def mapped(findings: DataFrame) -> DataFrame:
    """Findings with the controls that they put in doubt, and risk and priority."""
    table = F.broadcast(controls(findings.sparkSession))  # twenty rows
    both = findings.join(table, "cwe")
    return both.withColumn("_r", risk_priority(F.col("severity"))).select(*findings.columns, "cwe_title", *FRAMEWORKS, "_r.risk", "_r.priority")


def unmapped(findings: DataFrame) -> DataFrame:
    """Findings without a control, with the reason: never dropped in silence."""
    left = findings.join(F.broadcast(controls(findings.sparkSession)).select("cwe"), "cwe", "left_anti")
    return left.withColumn("reason", F.when(F.col("cwe").isNull(), "no cwe").otherwise(F.concat(F.lit("unmapped "), "cwe")))


# The fields of a risk by target; a column, or a constant in quotes.
TARGETS = {
    "gapps": {"title": "title", "description": "description", "status": "'new'", "risk": "risk", "priority": "priority"},
    "comp": {"title": "title", "description": "description", "category": "'technology'", "status": "'open'"},
}


def payloads(findings: DataFrame, target: str) -> DataFrame:
    """One JSON document for each mapped finding, in the shape of ``target``."""
    body = F.struct(*(F.expr(e).alias(f) for f, e in TARGETS[target].items()))
    return mapped(findings).select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def tagged(findings: DataFrame) -> DataFrame:
    """Mapped findings with ``tags``: every control as framework:control."""
    each = lambda f: F.transform(f, lambda c: F.concat(F.lit(f"{f}:"), c))
    return mapped(findings).withColumn("tags", F.flatten(F.array(*map(each, FRAMEWORKS))))
