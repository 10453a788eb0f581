"""Streaming extensions over the append-only journal and tool output.

The audit itself has no streams; these read the same tables incrementally.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.journal import GENESIS, SCHEMA

LINKED = "journal string, ordinal long, entry_hash string, link_ok boolean"


def entries(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Entries of a folder of JSON-lines journals as they arrive, with the file's name as ``journal``."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return stream.withColumn("journal", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def linked(stream: DataFrame, order: str = "ordinal") -> DataFrame:
    """Link checks that go on over batches: the state of a journal is its last hash and count.

    ``stream`` has ``journal``, an order column, ``prev_hash`` and ``entry_hash``;
    a journal's entries must arrive in order from batch to batch."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (GENESIS, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for prev, own in zip(rows["prev_hash"], rows["entry_hash"]):
            out.append((key[0], count, own, prev == last))
            last, count = own, count + 1
        state.update((last, count))
        yield pd.DataFrame(out, columns=["journal", "ordinal", "entry_hash", "link_ok"])

    return stream.groupBy("journal").applyInPandasWithState(check, LINKED, "last string, n long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, ts: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    """First finding of each key within the watermark: streaming cross-tool dedup."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def counts_by_tool(stream: DataFrame, ts: str, tool: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings of each tool in tumbling windows; a window is final once the watermark has passed it."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tool", "n")
