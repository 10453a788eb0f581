"""Pages by key: deep pages without sorting or skipping what comes before them.

Rows are written once as a sorted run, a file for each range of the order, with the
first and last key of each file. A page is a seek: the files that can hold what
comes after the last key seen, one or two of them, are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from evidentia.scratch import Scratch

ROWS_A_FILE = 1_000_000


class SortedRun:
    """``rows`` in the ascending ``order`` of columns, nulls first. Rows that are equal in it, repeated ones too, get a
    number (``tie``) that tells them apart, so that no page leaves one out. An empty table has
    one empty page. ``rows`` must be deterministic, such as a stored table."""

    def __init__(self, rows: DataFrame, order: list[str], rows_a_file: int = ROWS_A_FILE) -> None:
        self.columns, self.order = rows.columns, order
        self.tie, self.part = "_tie", "_part"
        while {self.tie, self.part} & {c.lower() for c in rows.columns}:
            self.tie, self.part = self.tie + "_", self.part + "_"
        scratch, self.keys = Scratch(rows.sparkSession, "pages"), [*order, self.tie]
        files = max(1, -(-rows.count() // rows_a_file))
        dealt = rows.withColumn(self.tie, F.monotonically_increasing_id()).repartitionByRange(files, *self.keys).withColumn(self.part, F.spark_partition_id())
        dealt.sortWithinPartitions(self.part, *self.keys).write.option("compression", "zstd").partitionBy(self.part).parquet(f"{scratch.root}/run")
        self.rows = scratch.read("run", dealt)
        self.types = {f.name: f.dataType for f in self.rows.schema}
        key = F.struct(*self.keys)
        bounds = self.rows.groupBy(self.part).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
        self.bounds = scratch.keep(bounds, "bounds")

    def _after(self, cursor: Sequence, of: str = "") -> Column:
        """True for keys beyond ``cursor``, which may be a prefix of the order: then for those beyond all that begin so."""
        names = self.keys[: len(cursor)]
        here = F.struct(*(F.col(of + n).alias(n) for n in names))
        return here > F.struct(*(F.lit(v).cast(self.types[n]).alias(n) for n, v in zip(names, cursor)))

    def after(self, cursor: Sequence | None = None, size: int = 100) -> DataFrame:
        """The ``size`` rows that follow ``cursor``, or the first ones, with ``tie`` as last column, in order."""
        ahead = self.bounds if cursor is None else self.bounds.where(self._after(cursor, "last."))
        parts, behind = [], 0
        for i, b in enumerate(ahead.orderBy("first").select(self.part, "n").limit(size + 1).collect()):  # a file has a row at least
            parts.append(b[self.part])
            behind += b["n"] if i or cursor is None else 0  # how much of the first file is beyond the cursor is not known
            if behind >= size:
                break
        some = self.rows.where(F.col(self.part).isin(parts)) if parts else self.rows.limit(0)
        some = some if cursor is None else some.where(self._after(cursor))
        return some.orderBy(*self.keys).limit(size).select(*self.columns, self.tie)

    def cursor(self, row: Row) -> tuple:
        """Where the page after this row begins."""
        return tuple(row[k] for k in self.keys)

    def drain(self, size: int = 100) -> Iterator[list[Row]]:
        """All pages, one after the other; a page at a time is on the driver."""
        cursor = None
        while page := self.after(cursor, size).collect():
            yield page
            cursor = self.cursor(page[-1])
