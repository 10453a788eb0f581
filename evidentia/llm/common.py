"""Shared helpers: byte-level word rules, shared scratch tables, safe joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import scratch
from evidentia.joins import join_by_count  # noqa: F401  used by the operators here
from evidentia.numbering import number_within  # noqa: F401  used by the operators here

#: Bytes of an Arrow batch at most.
BATCH_BYTES = 4 << 20

#: bytes.translate table: A-Z to a-z, everything else unchanged.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: bytes.translate table: A-Z to a-z, and every ASCII byte that is neither a
#: letter nor a digit to a space. Bytes from 0x80 up stay, so that
#: ``text.translate(ASCII_WORDS).split()`` yields words of
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ASCII_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def texts_of(column: pa.Array, rows: int = 128) -> Iterator[list[str | None]]:
    """Python values of an Arrow string column, a few rows at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


class Scratch(scratch.Scratch):
    """The core's written tables, for operators that run Python on the rows: an
    Arrow batch is bounded in bytes, so that long texts don't fill a worker."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        super().__init__(spark, name)
        bound_batches(spark)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let an Arrow batch have ``most`` bytes at most, or one row, where the session has set no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
