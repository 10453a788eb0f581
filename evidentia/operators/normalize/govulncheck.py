"""govulncheck: a stream of two kinds of records, joined on the advisory id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import without_root
from evidentia.operators.normalize.base import COLUMNS, line, text
from evidentia.operators.normalize.tools import ndjson

_RECORD = (
    "struct<osv:struct<id:string,summary:string,details:string,aliases:array<string>>,"
    "finding:struct<osv:string,trace:array<struct<position:struct<filename:string,line:bigint>>>>>"
)


def findings(docs: DataFrame) -> DataFrame:
    """Findings with the last advisory of their id in the same document; others go."""
    keys = [c for c in docs.columns if c != "raw"]
    rows = docs.select(*keys, F.posexplode(ndjson(_RECORD)(F.col("raw"))).alias("ordinal", "x"))
    osv = rows.where(F.coalesce(F.col("x.osv.id"), F.lit("")) != "").groupBy(*keys, F.col("x.osv.id").alias("rule_id")).agg(F.max_by("x.osv", "ordinal").alias("o"))
    hits = rows.where("x.finding IS NOT NULL").select(*keys, "ordinal", F.col("x.finding.osv").alias("rule_id"), F.coalesce("x.finding.trace", F.array()).alias("trace"))
    both = hits.join(osv, [*keys, "rule_id"])
    at, o = F.get("trace", 0)["position"], F.col("o")
    first = line(at["line"])
    columns = {
        "tool": F.lit("govulncheck"), "rule_id": F.col("rule_id"), "file_path": F.when(at.isNull(), "go.mod").otherwise(without_root(text(at["filename"]))),
        "line_start": first, "line_end": first, "severity": F.when(F.size("trace") > 0, "high").otherwise("medium"), "confidence": F.lit("high"),
        "cwe": F.get(F.filter(o["aliases"], lambda a: a.startswith("CWE-")), 0), "owasp": F.lit(None).cast("string"),
        "title": F.when(text(o["summary"]) == "", F.col("rule_id")).otherwise(F.concat("rule_id", F.lit(": "), o["summary"])),
        "description": F.when(text(o["details"]) == "", text(o["summary"])).otherwise(o["details"]),
    }
    return both.select(*keys, "ordinal", *(columns[c].alias(c) for c in COLUMNS))
