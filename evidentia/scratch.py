"""Tables written between steps, in the folder that the cluster shares.

A written table survives lost executors, pins what a non-deterministic step
returned and keeps plans small. Every run of an operator writes below a folder
of its own; :func:`release` deletes what this process has written so far.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: list[str] = []
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset in local mode (tests), a temporary folder is made and
    set; it goes when the process ends. On a cluster an unset folder is an
    error, since a machine's own folder would hold only its own parts.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop(spark: SparkSession, root: str) -> None:
    for table in _tables.pop(root, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, root)


class Scratch:
    """The written tables of one run of an operator. ``free`` deletes tables
    that no later step reads, ``close`` all of them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a reader of what was written."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def keep_bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Write ``df`` in buckets of ``keys`` and return a reader of them: a join on these
        keys moves only its other side. The table is external, in the session's
        catalogue, and its name goes with :meth:`close` or :func:`release`."""
        table = f"scratch_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, *keys)
        dealt.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, *keys).saveAsTable(table)
        _tables.setdefault(self.root, []).append(table)
        return self.spark.table(table)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def free(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        _drop(self.spark, self.root)
        if self.root in _roots:
            _roots.remove(self.root)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of its own."""
    return Scratch(df.sparkSession, name).keep(df, "rows")


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has written; results that still read
    them are lost. Returns the number of folders deleted."""
    done = len(_roots)
    while _roots:
        _drop(spark, _roots.pop())
    return done
