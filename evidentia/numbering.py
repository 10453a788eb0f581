"""Gapless numbers within groups, without a task that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.scratch import Scratch


def number_within(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch, rows_a_bucket: int = 50_000) -> DataFrame:
    """Add ``name``: a gapless number from 0 for the rows of each group.

    No task ever holds a whole group: rows are dealt to hash buckets of
    ``order``, each bucket is numbered by itself, and the counts of the buckets
    before it are added. A bucket of the largest group has about
    ``rows_a_bucket`` rows, or a thousandth of all rows where that is less.
    ``order`` must tell rows apart for a number that does not depend on the
    run; rows equal in it are numbered in any order. Groups are not null.
    ``df`` is read three times, so it should be a written table.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    each = max(200, min(rows_a_bucket, (sizes["all"] or 0) // 1000))
    buckets = max(1, -(-(sizes["most"] or 0) // each))
    return _numbered(df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))), group, order, name, scratch)


def number_in_order(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch, rows_a_range: int = 1_000_000, total: str | None = None) -> DataFrame:
    """Add ``name``: the place, from 0, of each row in the ``order`` (columns,
    ascending) of its group. Rows are dealt to ranges of (group, order), each
    range is numbered by itself, and what lies before it in the group is added.
    ``total`` names a column for the size of the group. ``df`` should be a written table, as ranges are sampled from it."""
    n = df.count()
    spark = df.sparkSession
    ranges = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000) or 1), -(-n // rows_a_range), 1)
    dealt = df.repartitionByRange(ranges, *group, *order).withColumn("_bucket", F.spark_partition_id())
    return _numbered(scratch.keep(dealt, f"ranges_{name}"), group, order, name, scratch, total)


def _numbered(dealt: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch, total: str | None = None) -> DataFrame:
    counts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    starts = scratch.keep(
        counts.select(*(F.col(k).alias(f"_s_{k}") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *([F.sum("_n").over(Window.partitionBy(*group)).alias(total)] if total else [])),
        f"starts_{name}",
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_s_{k}") for k in keys))
    # the starts grow with the rows, so they are merged, along the windows' partitioning, not broadcast
    found = numbered.join(starts.hint("merge"), on).withColumn(name, F.col("_at") + F.col("_start"))
    return found.drop("_bucket", "_at", "_start", *(f"_s_{k}" for k in keys))
