"""Tables dealt to buckets of a key, of which a step reads only those that it touches.

A bucket is a folder, so reading some of them is a partition filter. Which
buckets rows touch is told by aggregates that ride along with a write
(:func:`touching`), as words of bits: their size is that of the number of buckets,
whatever the rows.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

BUCKETS, WORD = 256, 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a key, from 0. Equal values of different types differ in it, so keys are cast before."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bit(n: Column) -> Column:
    """A long with bit ``n`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def touching(bucket: str, buckets: int = BUCKETS) -> list[Column]:
    """Aggregates that tell which buckets rows are in; :func:`touched` reads them."""
    at = F.col(bucket)
    return [F.bit_or(F.when(F.floor(at / WORD) == w, bit(at % WORD))).alias(f"_touched_{w}") for w in range(-(-buckets // WORD))]


def touched(told: dict) -> list[int]:
    """Buckets of observed aggregates, ascending."""
    words = {int(k.rsplit("_", 1)[1]): v or 0 for k, v in told.items() if k.startswith("_touched_")}
    return [w * WORD + b for w, v in sorted(words.items()) for b in range(WORD) if v >> b & 1]


def told_of(seen: Observation) -> dict:
    """What was observed of rows that have been written. Where an input turns out to be empty, adaptive plans leave
    the observation out; there is nothing to tell then."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "toPyRow" not in str(e):
            raise
        return {}


def put(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Append ``rows`` to a table, a file or so a bucket."""
    rows.repartition(bucket).write.mode("append").option("compression", "zstd").partitionBy(bucket).parquet(path)


def within(rows: DataFrame, buckets: list[int], bucket: str = "bucket") -> DataFrame:
    """Only the folders of these buckets."""
    return rows.where(F.col(bucket).isin(buckets)) if buckets else rows.where(F.lit(False))
