"""Read path of findings and chains: filters, projections, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import RANKS, cut_chars, severity_rank
from evidentia.schemas import TABLES

# Path noise, demoted sinks, CWE classes of proofs, page sizes.
NOISE = ["%/.github/%", ".github/%", "%/internal-docs/%", "internal-docs/%"]
TOOLING = [
    "%/scripts/%", "scripts/%", "%/notebooks/%", "notebooks/%", "%/test/%", "%/tests/%", "%_test.%", "%/fixtures/%", "%_mock.%", "%/mocks/%",
    "%/mock/%",
]
PROVABLE = ["CWE-89", "CWE-78", "CWE-22", "CWE-94", "CWE-79"]
PAGE_SIZE, LARGEST_PAGE, DESCRIPTION = 30, 100, 600

COMPACT = ["id", "file_path", "line_start", "line_end", "cwe", "severity", "title", "tool_origin"]


def matches_any(text: Column, patterns: list[str]) -> Column:
    """ASCII case-insensitive LIKE of any pattern; ``_`` and ``%`` are wildcards."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.ilike(p)
    return out


def without_noise(findings: DataFrame) -> DataFrame:
    return findings.where(~matches_any(F.col("file_path"), NOISE))


def at_least(findings: DataFrame, floor: str | None) -> DataFrame:
    """Findings of the floor's rank or more; an absent or unknown floor filters nothing."""
    rank = RANKS.get(floor or "", 0)
    return findings.where(severity_rank(F.col("severity")) >= rank) if rank else findings


def of_tool(findings: DataFrame, tool: str | None) -> DataFrame:
    return findings.where(F.col("tool_origin") == tool) if tool else findings


# What the enumerated columns of a finding may hold.
DOMAINS = {
    "severity": ["critical", "high", "medium", "low", "info"], "confidence": ["high", "medium", "low"],
    "advocate_verdict": ["confirmed", "rebutted", "uncertain"],
    "poc_status": ["reproduced", "refuted", "inconclusive", "reproduced_by_citation"],
}


def whole(findings: DataFrame) -> DataFrame:
    """All columns of the findings table, in its order and types, absent ones as null;
    ``decode_error`` names the enumerated columns with a value outside their domain."""
    have = set(findings.columns)
    kinds = [c.split() for c in TABLES["findings"].split(", ")]
    wrong = [F.when(~F.col(c).isin(d), F.lit(c)) for c, d in DOMAINS.items() if c in have]
    error = F.array_join(F.array_compact(F.array(*wrong)), ",") if wrong else F.lit("")
    return findings.select(*((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds), F.nullif(error, F.lit("")).alias("decode_error"))


def detail(findings: DataFrame, engagement_id: str, finding_id: str) -> DataFrame:
    """One finding with its whole text and all columns."""
    return whole(findings.where((F.col("engagement_id") == engagement_id) & (F.col("id") == finding_id)))


def compact(findings: DataFrame) -> DataFrame:
    return findings.select(*COMPACT)


def listed(findings: DataFrame) -> DataFrame:
    """List projection: the compact columns and the description cut to 600 characters."""
    return findings.select(*COMPACT[:-1], cut_chars(F.col("description"), DESCRIPTION).alias("description"), "tool_origin")


def by_priority() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("id").asc()]


def triage_first(tool: str = "triage") -> list[Column]:
    return [F.when(F.col("tool_origin") == tool, 0).otherwise(1).asc(), F.col("id").asc()]


def by_tier() -> list[Column]:
    """Chains without a guard first, then sinks in production code, then id."""
    unguarded = F.array_contains("sanitizers_seen", "unguarded")
    return [
        F.when(F.coalesce(unguarded, F.lit(False)), 0).otherwise(1).asc(), F.when(matches_any(F.col("sink_file"), TOOLING), 1).otherwise(0).asc(),
        F.col("id").asc(),
    ]


def chain_list(chains: DataFrame) -> DataFrame:
    """List projection of taint chains: hops are counted, not shown."""
    return chains.select(
        "id", "source_file", "source_line", "sink_file", "sink_line", F.size("chain").alias("hop_count"),
        F.coalesce(F.array_contains("sanitizers_seen", "unguarded"), F.lit(False)).alias("unguarded"),
    )


def page_bounds(page: int | None, size: int | None) -> tuple[int, int, int]:
    """(page, size, offset): pages from 0, size 30 by default and 1 to 100."""
    size = max(1, min(LARGEST_PAGE, PAGE_SIZE if size is None else size))
    page = max(0, page or 0)
    return page, size, page * size


def page(rows: DataFrame, order: list[Column], page: int | None = 0, size: int | None = None) -> DataFrame:
    """One page of ``rows``: a top-k sort, never a whole one for early pages."""
    _, size, offset = page_bounds(page, size)
    return rows.orderBy(*order).offset(offset).limit(size)


def envelope(rows: DataFrame, order: list[Column], number: int | None = 0, size: int | None = None, **markers) -> DataFrame:
    """A page as one row: rows, page, page_size, total, returned, has_more, and markers.

    The total is counted under the predicates of the page."""
    number, size, offset = page_bounds(number, size)
    cols = rows.columns
    ordered = [F.struct(F.monotonically_increasing_id().alias("_at"), *cols)]
    shown = page(rows, order, number, size).coalesce(1).select(*ordered, )
    shown = shown.agg(F.sort_array(F.collect_list(shown.columns[0])).alias("_rows"))
    shown = shown.select(F.transform("_rows", lambda r: F.struct(*(r[c].alias(c) for c in cols))).alias("rows"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    both = shown.crossJoin(total)  # one row each
    returned = F.size("rows")
    return both.select(
        "rows", F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total", returned.alias("returned"),
        (F.lit(offset) + returned < F.col("total")).alias("has_more"), *(F.lit(v).alias(k) for k, v in markers.items()),
    )


def prioritised(findings: DataFrame, floor: str | None = None, number: int = 0, size: int | None = None) -> DataFrame:
    """Page of findings worth reading first: no path noise, a severity floor, by rank."""
    return page(compact(at_least(without_noise(findings), floor)), by_priority(), number, size)


def proof_candidates(findings: DataFrame) -> DataFrame:
    """Open findings of the provable classes that no proof has touched yet."""
    return findings.where(F.col("cwe").isin(PROVABLE) & (F.col("status") == "open") & F.col("poc_status").isNull())


def recall(triples: DataFrame, subject: str, most: int = 20) -> DataFrame:
    """Latest knowledge whose subject contains the text, over all engagements."""
    most = max(1, min(100, most))
    found = triples.where(F.col("subject").ilike(f"%{subject}%"))
    return found.orderBy(F.desc("created_at"), "engagement_id", "id").limit(most)
