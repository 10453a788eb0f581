"""Declared and locked dependencies, merged by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.dedup import first_of

# Manifests in order of precedence.
PRECEDENCE = {"requirements.txt": 0, "pyproject.toml": 1, "Pipfile": 2}


def merge(declared: DataFrame, locked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a name: the first declaration by ``precedence`` and ``ordinal`` is
    direct; the lock file sets ``resolved_version`` or adds a transitive row.

    ``declared``: name, version_spec, source_file, precedence, ordinal;
    ``locked``: name, version, source_file."""
    by = by or []
    first = first_of(declared, [*by, "name"], ["precedence", "ordinal"]).select(*by, "name", "version_spec", F.col("source_file").alias("_declared"))
    lock = locked.groupBy(*by, "name").agg(F.max_by(F.struct("version", "source_file"), "version").alias("_l"))
    both = first.join(lock, [*by, "name"], "full_outer")
    direct = F.col("_declared").isNotNull()
    return both.select(
        *by, "name", F.coalesce("version_spec", F.lit("")).alias("version_spec"), F.col("_l.version").alias("resolved_version"),
        F.coalesce("_declared", "_l.source_file").alias("source_file"), F.when(direct, "direct").otherwise("transitive").alias("kind"),
    )
