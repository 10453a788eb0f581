"""Sharding by longest-processing-time scheduling.

Texts that are equal form a group and stay together. Groups, sorted by size,
go to the least-loaded shard through a heap. The heap runs on the driver, so
what it sees has a bound: the sorted groups are cut into bundles of at most
``1 / (shards * FINENESS)`` of all bytes (a larger group is a bundle by
itself), which makes at most ``2 * shards * FINENESS + 1`` bundles at any
scale, and moves a shard's load by at most 1 / FINENESS of its share. Sorting,
cumulating and placing are distributed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, join_by_count, number_within

FINENESS = 512
OVERHEAD = 8  # bytes that a document costs besides its text


def schedule(bundles: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Bundle -> shard for (bundle, size) pairs: largest first, to the least-loaded
    shard, the lowest number where loads are equal."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for bundle, size in sorted(bundles, key=lambda b: (-b[1], b[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[bundle] = shard
    return placed


def _bundled(groups: DataFrame, shards: int, fineness: int, scratch: Scratch) -> tuple[DataFrame, list[tuple], int]:
    """Groups (``digest``, ``bytes``, ``n``) with their ``bundle``, the size of each bundle, and the number of rows."""
    spark = groups.sparkSession
    n, total, n_rows = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("n")).first()
    limit = max(1, (total or 0) // (shards * fineness))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Groups of over ``limit`` bytes are fewer than shards * fineness; each is a bundle.
    large = groups.where(F.col("bytes") > limit).withColumn("bundle", F.xxhash64("digest"))
    small = groups.where(F.col("bytes") <= limit)
    sorted_ = small.repartitionByRange(max(parts, -(-(n or 0) // 1_000_000)), F.desc("bytes"), "digest")
    sorted_ = scratch.keep(sorted_.withColumn("part", F.spark_partition_id()), "sorted")
    sums = {r.part: r.bytes for r in sorted_.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a partition
    starts, before = [], 0
    for part in sorted(sums):
        starts.append((part, before))
        before += sums[part]
    starts = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
    along = Window.partitionBy("part").orderBy(F.desc("bytes"), "digest").rowsBetween(Window.unboundedPreceding, -1)
    cumulated = sorted_.join(F.broadcast(starts), "part").withColumn("at", F.coalesce(F.sum("bytes").over(along), F.lit(0)) + F.col("start"))
    cut = cumulated.select("digest", "bytes", "n", F.floor(F.col("at") / limit).cast("long").alias("bundle"))
    both = cut.withColumn("large", F.lit(False)).unionByName(large.select("digest", "bytes", "n", "bundle", F.lit(True).alias("large")))
    both = scratch.keep(both, "bundled")
    sizes = both.groupBy("large", "bundle").agg(F.sum("bytes").alias("bytes")).collect()  # bounded; see the module
    return both, [((r.large, r.bundle), r.bytes) for r in sizes], n_rows or 0


def shard(docs: DataFrame, shards: int = 24, fineness: int = FINENESS) -> DataFrame:
    """Shard and slot of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    ``doc_id``, ``size`` (UTF-8 bytes of the text and 8 more; a null text has
    none and groups with the empty one), ``text_crc32``, ``shard``, ``slot``
    (from 0 without gaps in a shard) and ``group_id`` (SHA-256 of the text).
    Shards have near equal bytes; groups of equal texts stay together, so a
    group larger than a shard's share makes its shard larger. Rows that repeat
    are placed each for themselves, in the same shard. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("digest"))
    rows = scratch.keep(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    bundled, sizes, n_rows = _bundled(groups, shards, fineness, scratch)
    placed = schedule(sizes, shards)
    table = spark.createDataFrame([(*b, s) for b, s in placed.items()] or [(False, 0, 0)], "large boolean, bundle long, shard int")
    homes = bundled.join(F.broadcast(table), ["large", "bundle"]).select("digest", "n", "shard")  # bounded; see the module
    homed = scratch.keep(join_by_count(rows, homes, ["digest"], n_rows), "homed")
    scratch.free("sorted", "bundled", "rows")
    slotted = number_within(homed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", scratch)
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot", F.lower(F.hex("digest")).alias("group_id"))


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in 24 shards by the law ``bytes``, a row a row of the table; null
    texts are grouped with empty ones; an empty table gives no rows."""
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
