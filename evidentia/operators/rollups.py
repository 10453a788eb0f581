"""Aggregates: counts, buckets, summaries, latest rows, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.scalars import SEVERITIES, cost, severity_rank


def count_by_engagement(df: DataFrame) -> DataFrame:
    return df.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("n"))


def verdict_summary(findings: DataFrame) -> DataFrame:
    """Counts of verdicts and proof outcomes, one pass, a row an engagement."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return findings.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("total"), is_("advocate_verdict", "confirmed").alias("confirmed"), is_("advocate_verdict", "rebutted").alias("rebutted"),
        is_("advocate_verdict", "uncertain").alias("uncertain"), is_("poc_status", "reproduced").alias("reproduced"),
        is_("poc_status", "refuted").alias("refuted"),
    )


def severity_buckets(findings: DataFrame) -> DataFrame:
    """Findings by severity, worst first, with their number and smallest id; empty
    buckets don't show. :func:`bucketed` has the findings themselves."""
    known = findings.where(F.col("severity").isin(SEVERITIES)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return known.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(F.desc("severity_rank"), "severity")


def bucketed(findings: DataFrame) -> DataFrame:
    """Findings of known severities in the order of their buckets: worst first, then by id."""
    return findings.where(F.col("severity").isin(SEVERITIES)).orderBy(severity_rank(F.col("severity")).desc(), "severity", "id")


def citation_types(findings: DataFrame, citations: DataFrame, key: str = "finding_id") -> DataFrame:
    """Every finding with the sorted set of its citations' types; none is an empty list.
    Where both tables have engagements, a citation counts for its own only."""
    by = [c for c in ("engagement_id",) if c in findings.columns and c in citations.columns]
    types = citations.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col(key).alias("_id")).agg(F.array_sort(F.collect_set("citation_type")).alias("citations"))
    on = [F.col("id") == F.col("_id"), *(F.col(c) == F.col(f"_{c}") for c in by)]
    return findings.join(types, on, "left").drop("_id", *(f"_{c}" for c in by)).withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def latest(df: DataFrame, by: str | list[str], ts: Column | str, tie: Column | str) -> DataFrame:
    """The newest row of each group of ``by``, a column or several. ``max_by`` combines before the shuffle, so a group with many rows costs one row a task."""
    by = [by] if isinstance(by, str) else by
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"))
    return newest.select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def run_counters(rows: DataFrame) -> DataFrame:
    """Inserted, denied, deduplicated and errors of a run, from labelled rows."""
    is_ = lambda v: F.count_if(F.col("outcome") == v).alias(v)
    return rows.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("total_seen"), is_("inserted"), is_("denied"), is_("deduped"), is_("error"))


def guard_totals(chains: DataFrame) -> DataFrame:
    unguarded = F.coalesce(F.array_contains("sanitizers_seen", "unguarded"), F.lit(False))
    return chains.groupBy("engagement_id").agg(F.count_if(unguarded).alias("unguarded"), F.count_if(~unguarded).alias("guarded"))


def cost_rollup(usage: DataFrame, by: str, input_price: float = 3.0, output_price: float = 15.0) -> DataFrame:
    """Token sums and the estimated cost of each group."""
    sums = usage.groupBy(by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.withColumn("est_cost", cost(F.col("input_tokens"), F.col("output_tokens"), input_price, output_price))


def reads_since_store(steps: DataFrame, by: str, order: list[str], threshold: int = 6) -> DataFrame:
    """Watchdog: for each step the reads since the last store, and whether there are ``threshold`` or more."""
    along = Window.partitionBy(by).orderBy(*order)
    island = F.sum(F.when(F.col("action") == "store", 1).otherwise(0)).over(along)
    runs = steps.withColumn("island", island)
    inside = Window.partitionBy(by, "island").orderBy(*order)
    reads = F.sum(F.when(F.col("action") == "read", 1).otherwise(0)).over(inside)
    return runs.withColumn("reads_since_store", reads).withColumn("warn", F.col("reads_since_store") >= threshold).drop("island")


def first_match(values: Column, prefix: str) -> Column:
    """The first element that begins with ``prefix``, else null."""
    return F.get(F.filter(values, lambda v: v.startswith(prefix)), 0)
