"""An index of the keys that a stored table has, so that an insertion doesn't read the table.

Digests of keys are dealt to buckets beside the table; an insertion reads the
buckets that its rows touch. The table's files are what counts: names of the files whose
keys are in the index are kept with it, so rows that were appended otherwise, or
by a run that was lost afterwards, are caught up with, a file once. Where a file that
was indexed is gone, as after an overwrite, the index is built anew.
"""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.scratch import Scratch, _delete
from evidentia.sources.dealt import BUCKETS, bucket_of, put, touched, touching, within


def digest(keys: list[str]) -> Column:
    """SHA-256 of a key's values, nulls told apart from texts."""
    return F.unhex(F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))


def _path(uri: str) -> str:
    """The path that a file's address stands for."""
    at = urlsplit(uri)
    return f"{at.scheme}://{at.netloc}{unquote(at.path)}" if at.scheme else unquote(uri)


class KeyIndex:
    """Keys of the Parquet table at ``table``, in the index at ``root``. One writer at a time; the driver sees names of files, as
    whoever lists the table does."""

    def __init__(self, spark: SparkSession, root: str, table: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.table, self.schema, self.keys, self.buckets = spark, root, table, schema, keys, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def known(self, buckets: list[int]) -> DataFrame:
        """Digests in these buckets."""
        return within(self._read("rows", "digest binary, bucket int"), buckets)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("digest", digest(self.keys)).withColumn("bucket", bucket_of(["digest"], self.buckets))

    def catch_up(self, rows: DataFrame) -> int:
        """Index the files of ``rows``, the table as it is, that are not yet in. Returns their number."""
        files = {_path(f) for f in rows.inputFiles()}
        names = {r.file for r in self._read("covered", "file string").collect()}
        if names - files:
            _delete(self.spark, self.root)
            names = set()
        missing = sorted(files - names)
        if missing:
            some = self.spark.read.schema(self.schema).option("basePath", self.table).parquet(*missing) if names else rows
            put(self._keyed(some).select("digest", "bucket").distinct(), f"{self.root}/rows")
            self.spark.createDataFrame([(f,) for f in missing], "file string").coalesce(1).write.mode("append").parquet(f"{self.root}/covered")
        return len(missing)

    def new(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Those of ``rows`` whose key is not in the index. :meth:`catch_up` comes first."""
        keyed = scratch.keep(self._keyed(rows), "keyed")
        meets = touched(keyed.agg(*touching("bucket", self.buckets)).first().asDict())
        known = self.known(meets).select(F.col("digest").alias("_digest"), F.col("bucket").alias("_bucket"))
        return keyed.join(known, (F.col("digest") == F.col("_digest")) & (F.col("bucket") == F.col("_bucket")), "left_anti").drop("digest", "bucket")
