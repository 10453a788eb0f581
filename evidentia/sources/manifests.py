"""Dependency manifests, tool manifests and scope files: TOML and requirement lines."""

from __future__ import annotations

import os
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.scalars import VERSION_OPERATORS, split_requirement
from evidentia.operators.dependencies import PRECEDENCE, merge
from evidentia.sources.files import basename

DECLARED = "name string, version_spec string, source_file string, precedence int, ordinal int"


def requirement_lines(files: DataFrame) -> DataFrame:
    """Declared dependencies of requirements.txt files; blank lines, comments and options go."""
    rows = files.where(basename(F.col("path")) == "requirements.txt").select(F.col("path").alias("source_file"), F.posexplode(F.split("text", "\r?\n")).alias("ordinal", "line"))
    rows = rows.where(~F.trim("line").rlike(r"^($|#|-)")).withColumn("r", split_requirement(F.col("line")))
    return rows.select("r.name", "r.version_spec", "source_file", F.lit(0).alias("precedence"), "ordinal").where("name <> ''")


def _cut(requirement: str) -> tuple[str, str]:
    for op in VERSION_OPERATORS:
        if op in requirement:
            name, _, rest = requirement.partition(op)
            return name.split("[")[0].strip(), op + rest
    return requirement.split("[")[0].strip(), ""


def _spec(value: object) -> str:
    return value if isinstance(value, str) else str(value.get("version", "")) if isinstance(value, dict) else ""


def toml_declared(path: str, text: str) -> list[tuple[str, str]]:
    """(name, version_spec) of a pyproject.toml (PEP 621, then Poetry) or a Pipfile; unreadable files have none."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    if os.path.basename(path) == "Pipfile":
        return [(n, _spec(v)) for part in ("packages", "dev-packages") for n, v in data.get(part, {}).items()]
    found = [_cut(r) for r in data.get("project", {}).get("dependencies", [])]
    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return found + [(n, _spec(v)) for n, v in poetry.items() if n != "python"]


def toml_locked(text: str) -> list[tuple[str, str]]:
    try:
        return [(p["name"], str(p.get("version", ""))) for p in tomllib.loads(text).get("package", []) if "name" in p]
    except tomllib.TOMLDecodeError:
        return []


def dependencies(files: DataFrame) -> DataFrame:
    """Merged dependencies of all manifests among ``files`` (``path``, ``text``)."""

    def declared(batches):
        for pdf in batches:
            rows = [(n, v, p, PRECEDENCE[os.path.basename(p)], i) for p, t in zip(pdf["path"], pdf["text"]) for i, (n, v) in enumerate(toml_declared(p, t))]
            yield pd.DataFrame(rows, columns=["name", "version_spec", "source_file", "precedence", "ordinal"])

    def locked(batches):
        for pdf in batches:
            rows = [(n, v, p) for p, t in zip(pdf["path"], pdf["text"]) for n, v in toml_locked(t)]
            yield pd.DataFrame(rows, columns=["name", "version", "source_file"])

    name = basename(F.col("path"))
    some = files.select("path", "text")
    all_declared = requirement_lines(files).unionByName(some.where(name.isin("pyproject.toml", "Pipfile")).mapInPandas(declared, DECLARED))
    return merge(all_declared, some.where(name == "poetry.lock").mapInPandas(locked, "name string, version string, source_file string"))


# What a tool manifest must have.
REQUIRED = ["name", "version", "description"]
NAME = re.compile(r"^[a-z][a-z0-9_]*$")


def tool_manifests(spark: SparkSession, folder: str, suffix: str = ".toml") -> DataFrame:
    """Tool manifests of a folder, sorted by path; an invalid one raises ValueError."""
    rows = []
    for file in sorted(f for f in os.listdir(folder) if f.endswith(suffix)):
        with open(os.path.join(folder, file), "rb") as f:
            data = tomllib.load(f)
        tool = data.get("tool", data)
        missing = [k for k in REQUIRED if not tool.get(k)]
        if missing or not NAME.match(tool["name"]):
            raise ValueError(f"{file}: {'lacks ' + ', '.join(missing) if missing else 'bad name'}")
        policy = tool.get("cedar") or tool.get("policy") or data.get("cedar") or {}
        args = data.get("args") or tool.get("args") or {}
        rows.append((file, tool["name"], str(tool["version"]), tool["description"], policy.get("resource"), policy.get("action"), sorted(args)))
    return spark.createDataFrame(rows, "path string, name string, version string, description string, resource string, action string, args array<string>")


def scope_overrides(path: str) -> dict[str, list[str]]:
    """Sources, sinks, guards, included and excluded paths of a scope file; absent lists are empty."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    return {k: list(data.get(k, [])) for k in ("sources", "sinks", "guards", "in_scope_paths", "exclude_paths")}
