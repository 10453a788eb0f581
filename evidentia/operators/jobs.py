"""Which scanner runs for which language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.dedup import first_of

# Language, the scanner image's short name, tool and phase, in job order.
JOBS = [
    ("python", "python", "semgrep", "sast"), ("python", "python", "bandit", "sast"), ("python", "python", "ruff", "sast"),
    ("python", "python", "pip_audit", "deps"), ("rust", "rust", "cargo_audit", "deps"), ("rust", "rust", "clippy", "sast"),
    ("rust", "rust", "semgrep", "sast"), ("typescript", "typescript", "eslint", "sast"), ("typescript", "typescript", "npm_audit", "deps"),
    ("typescript", "typescript", "semgrep", "sast"), ("javascript", "typescript", "eslint", "sast"), ("javascript", "typescript", "npm_audit", "deps"),
    ("javascript", "typescript", "semgrep", "sast"), ("go", "go", "gosec", "sast"), ("go", "go", "govulncheck", "deps"), ("go", "go", "staticcheck", "sast"),
    ("java", "java", "semgrep", "sast"), ("java", "java", "compromised_packages", "deps"), ("php", "php", "semgrep", "sast"), ("php", "php", "progpilot", "sast"),
    ("php", "php", "compromised_packages", "deps"), ("python", "python", "compromised_packages", "deps"), ("rust", "rust", "compromised_packages", "deps"),
    ("typescript", "typescript", "compromised_packages", "deps"), ("javascript", "typescript", "compromised_packages", "deps"),
    ("iac", "iac", "checkov", "sast"), ("iac", "iac", "trivy", "sast"),
]


def job_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *j) for i, j in enumerate(JOBS)], "job_ord int, language string, container string, tool string, phase string")


def detected_languages(facts: DataFrame) -> DataFrame:
    """Distinct (engagement_id, language) from language facts."""
    name = F.get_json_object("json", "$.name")
    return facts.where((F.col("kind") == "language") & name.isNotNull()).select("engagement_id", name.alias("language")).distinct()


def select_jobs(languages: DataFrame, by: str | None = "engagement_id") -> DataFrame:
    """Jobs of the detected languages; of jobs with one container and tool the first in the table."""
    jobs = F.broadcast(job_table(languages.sparkSession))
    key = [by] if by else []
    both = jobs.join(languages.select(*key, "language").distinct(), "language")
    return first_of(both, [*key, "container", "tool"], ["job_ord"]).select(*key, "job_ord", "language", "container", "tool", "phase")
