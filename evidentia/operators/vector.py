"""Vector collections: embedding, indexing and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evidentia.scratch import Scratch

#: Bytes of the queries that a pass holds.
QUERY_BYTES = 256 << 20

SCHEMA = "id string, kind string, engagement_id string, text string, vector array<float>"


def byte_embedder(dim: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for a model: the first ``dim`` bytes over 255."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            data = (t or "").encode()[:dim]
            out.append([b / 255 for b in data] + [0.0] * (dim - len(data)))
        return out

    return embed


def embedded(text: Column, provider: Callable[[list[str]], list[list[float]]], dim: int) -> Column:
    """Vectors of texts from a provider: a batch in, as many vectors of ``dim`` out."""

    @F.pandas_udf(ArrayType(FloatType()))
    def of(texts: pd.Series) -> pd.Series:
        vectors = provider(texts.tolist())
        if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
            raise ValueError(f"the provider must return {len(texts)} vectors of {dim}")
        return pd.Series(vectors)

    return of(text)


def indexed(rows: DataFrame, kind: str, provider: Callable, dim: int, text: str = "text") -> DataFrame:
    """Rows (``id``, ``engagement_id``, ``text``, others) as collection rows: other columns become the payload."""
    payload = F.to_json(F.struct(*rows.columns))
    return rows.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), "engagement_id", payload.alias("text"), embedded(F.col(text), provider, dim).alias("vector"))


class Collection:
    """A Parquet collection of vectors, partitioned by kind."""

    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.spark, self.path, self.dim = spark, path, dim

    def insert(self, rows: DataFrame, distinct: bool = False) -> None:
        wrong = rows.where(F.coalesce(F.size("vector"), F.lit(-1)) != self.dim)
        if not wrong.isEmpty():
            raise ValueError(f"vectors of this collection have {self.dim} numbers")
        rows = rows.dropDuplicates(["id", "kind", "engagement_id"]) if distinct else rows
        rows.write.mode("append").partitionBy("kind").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, on the JVM."""
    double = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "vector", key: str = "id") -> DataFrame:
    """The ``k`` nearest rows to one query, by distance, then key.

    The filter comes first and the sort is a top-k, so a task sends k rows."""
    pool = rows if where is None else rows.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return pool.withColumn("distance", squared_l2(F.col(vector), q)).orderBy("distance", key).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, dim: int, vector: str = "vector", key: str = "id", query_key: str = "query_id", block: int = 512, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` nearest rows to every row of ``queries``: a stated query set
    against all rows, in blocks. Each task scans its rows against a block of
    queries and keeps k a query; the k best are then merged by key.

    Queries of more than ``most_bytes`` together are dealt to passes by their key; what a pass
    finds is a written table, so one pass at a time is in memory."""
    queries = queries.select(query_key, vector)
    passes = -(-queries.count() * dim * 8 // most_bytes)
    if passes <= 1:
        return _nearest_pass(rows, queries, k, dim, vector, key, query_key, block)
    scratch, found = Scratch(rows.sparkSession, "nearest"), []
    dealt = scratch.keep(queries.withColumn("_pass", F.pmod(F.xxhash64(query_key), F.lit(passes))), "queries")
    for at in range(passes):
        mine = dealt.where(F.col("_pass") == at).drop("_pass")
        found.append(scratch.keep(_nearest_pass(rows, mine, k, dim, vector, key, query_key, block), f"pass_{at}"))
    return reduce(DataFrame.unionByName, found)


def _nearest_pass(rows: DataFrame, queries: DataFrame, k: int, dim: int, vector: str, key: str, query_key: str, block: int) -> DataFrame:
    """Queries that a worker holds at once, against all rows."""
    import numpy as np

    held = queries.select(query_key, F.col(vector).cast("array<double>").alias("v")).toPandas()
    ids, matrix = held[query_key].to_numpy(), np.array(held["v"].tolist(), np.float64).reshape(-1, dim)
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def scan(batches):
        ids, matrix = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim)
            keys = pdf[key].to_numpy()
            order = np.argsort(keys, kind="stable")
            x, keys = x[order], keys[order]
            for at in range(0, len(ids), block):
                d = ((matrix[at : at + block, None, :] - x[None, :, :]) ** 2).sum(-1) if len(x) * block * dim < 20_000_000 else np.stack([((q - x) ** 2).sum(-1) for q in matrix[at : at + block]])
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                for i, row in enumerate(best):
                    yield pd.DataFrame({query_key: ids[at + i], key: keys[row], "distance": d[i, row]})

    kinds = dict(rows.dtypes) | {query_key: dict(queries.dtypes)[query_key]}
    near = rows.select(key, F.col(vector).cast("array<double>").alias("v")).mapInPandas(scan, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", key))), 1, k)
    return near.groupBy(query_key).agg(best.alias("b")).select(query_key, F.posexplode("b").alias("rank", "h")).select(query_key, "rank", f"h.{key}", "h.distance")


def decoded(hits: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Payloads of hits; one that does not parse is nulls, or an error with ``strict``."""
    return hits.select("id", "distance", F.from_json("text", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("p")).select("id", "distance", "p.*")
