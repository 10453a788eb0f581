"""What all scanner normalisers share: their input, their output, small rules."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import cases, without_root

COLUMNS = ["tool", "rule_id", "file_path", "line_start", "line_end", "severity", "confidence", "cwe", "owasp", "title", "description"]


class Items(Protocol):
    """From the raw text of a document to an array of structs, one for each finding; null where the container is missing."""

    def __call__(self, raw: Column) -> Column: ...


@dataclass(frozen=True)
class Tool:
    """A document format: its items, and the eleven columns of an item."""

    name: str
    items: Items
    columns: dict
    strips_root: bool = True

    def findings(self, docs: DataFrame, strip_repo_prefix: bool = False) -> DataFrame:
        """Findings of documents (``raw`` and any key columns).

        Keys come back with ``ordinal``, the place of the raw row in its
        document, and the eleven columns. A document without its container has
        no findings; see :func:`errors`. ``strip_repo_prefix`` strips the mount
        point for tools that leave it on, so that tools agree on paths."""
        keys = [c for c in docs.columns if c != "raw"]
        rows = docs.select(*keys, F.posexplode(self.items(F.col("raw"))).alias("ordinal", "x"))
        x = F.col("x")
        out = {c: self.columns[c](x) if c in self.columns else F.lit(None).cast("string") for c in COLUMNS if c != "tool"}
        out["tool"] = F.lit(self.name)
        if self.strips_root or strip_repo_prefix:
            out["file_path"] = without_root(out["file_path"])
        typed = [(out[c].cast("int") if c.startswith("line_") else out[c].cast("string")).alias(c) for c in COLUMNS]
        return rows.select(*keys, "ordinal", *typed)

    def errors(self, docs: DataFrame) -> DataFrame:
        """Keys of the documents whose container is missing or unreadable, with ``error``."""
        keys = [c for c in docs.columns if c != "raw"]
        return docs.where(self.items(F.col("raw")).isNull()).select(*keys, F.lit(f"{self.name}: unexpected document").alias("error"))


def text(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def line(value: Column, default: Column | int = 0) -> Column:
    """A line number; missing or out of range ones are the default."""
    other = F.lit(default) if isinstance(default, int) else default
    return F.when(value.between(0, 2147483647), value).otherwise(other).cast("int")


def not_negative(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("int")


def one_of(value: Column, table: dict[str, str], default: str) -> Column:
    return cases(F.upper(text(value)), table, default)


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Fixed code -> CWE table; null for codes that have none."""
    return cases(value, table, F.lit(None).cast("string"))


def const(value: str):
    return lambda x: F.lit(value)


def lines(raw: Column) -> Column:
    """Trimmed lines that are not blank; null for a text without any."""
    all_ = F.filter(F.transform(F.split(raw, "\r?\n"), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.size(all_) > 0, all_)


def note(body: Column, label: str, extra: Column) -> Column:
    """The body, and a labelled paragraph if there is anything to say."""
    return F.when(text(extra) == "", body).otherwise(F.concat(body, F.lit(f"\n\n{label}: "), extra))
