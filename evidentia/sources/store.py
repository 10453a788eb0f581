"""The evidence store: one Parquet folder a table, partitioned by engagement."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.schemas import KEYS, TABLES, empty
from evidentia.sources.dealt import BUCKETS
from evidentia.sources.keys import KeyIndex


class Store:
    """Tables under a root path. Reads of a table that was never written are empty."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        """``buckets``: folders of a table's key index."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def open(self) -> Store:
        """Register every table as a temporary view of its name."""
        for table in TABLES:
            self.read(table).createOrReplaceTempView(table)
        return self

    def read(self, table: str, engagement_id: str | None = None) -> DataFrame:
        """A table; with ``engagement_id`` only that partition is scanned."""
        try:
            df = self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}")
            df.isEmpty()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = empty(self.spark, table)
        return df if engagement_id is None else df.where(F.col("engagement_id") == engagement_id)

    def _conformed(self, table: str, rows: DataFrame) -> DataFrame:
        """Columns of the table in its order and types; missing ones are null."""
        have = set(rows.columns)
        schema = empty(self.spark, table).schema
        return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def append(self, table: str, rows: DataFrame) -> None:
        out = self._conformed(table, rows).write.mode("append")
        if table != "engagements" and "engagement_id" in TABLES[table]:
            out = out.partitionBy("engagement_id")
        out.parquet(f"{self.root}/{table}")

    def keys(self, table: str) -> KeyIndex:
        return KeyIndex(self.spark, f"{self.root}/keys_of_{table}", f"{self.root}/{table}", TABLES[table], KEYS[table], self.buckets)

    def insert_or_ignore(self, table: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Append the rows whose key is new; of rows of one key the first in ``order``.

        Of what is stored, the files that came since the last insertion are read, for their
        keys, and the touched buckets of the key index. Null is a key like any other."""
        from evidentia.operators.dedup import first_of
        from evidentia.scratch import Scratch

        index, scratch = self.keys(table), Scratch(self.spark, "insert")
        index.catch_up(self.read(table))
        first = first_of(self._conformed(table, rows), list(KEYS[table]), order or KEYS[table])
        self.append(table, index.new(first, scratch))
        scratch.close()

    def overwrite_engagement(self, table: str, engagement_id: str, rows: DataFrame) -> None:
        """Replace one engagement's partition; ``rows`` may be derived from it."""
        from evidentia.scratch import written

        kept = written(self._conformed(table, rows).where(F.col("engagement_id") == engagement_id), f"{table}-new")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engagement_id").parquet(f"{self.root}/{table}")
