"""Centroid clustering with Elkan's bounds, in exact integers.

Vectors are integers, so distances, sums and new centroids are exact and do not
depend on how rows are dealt. Each vector keeps an upper bound of the distance
to its centroid and a lower bound to each centroid; the table of vectors with
their bounds is written once a round and read by the next. A distance is worked
out only where neither a lower bound nor half of the distance between two
centroids is larger than the upper bound. Bounds are rounded away from the
truth, and a centroid is skipped only where it is strictly farther, so that of
equally near centroids the smaller number is found as if all were compared.

Rows stay in the partition where they were read: a round is one pass over the
table and one sum per cluster, combined before it is shuffled. The driver sees
the centroids, their sums and their counts, and nothing of the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components lie within this, so that the square of a distance is a long.
LARGEST = 1 << 27

_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def _root_up(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers, never too small."""
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf).astype(np.float32), _UP)


def _root_down(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers, never too large."""
    down = np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf).astype(np.float32), _DOWN)
    return np.maximum(down, np.float32(0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def assign(x: np.ndarray, centroids: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Move every vector to its nearest centroid; ``at``, ``upper`` and ``lower`` change
    in place. Returns exact squared distances and how many were worked out in
    the search (those of the last line, one a vector, are not counted)."""
    k = len(centroids)
    between = np.stack([squared(centroids, centroids[c : c + 1]) for c in range(k)])
    half = np.nextafter(_root_down(between) * np.float32(0.5), _DOWN)
    np.fill_diagonal(half, np.inf)
    worked = 0
    best = np.full(len(x), -1, np.int64)  # exact where it is not negative
    left = np.flatnonzero(~(half.min(axis=1)[at] > upper))
    for c in range(k):
        rows = left[(at[left] != c) & ~(lower[left, c] > upper[left]) & ~(half[c, at[left]] > upper[left])]
        loose = rows[best[rows] < 0]
        if len(loose):
            best[loose] = squared(x[loose], centroids[at[loose]])
            upper[loose] = _root_up(best[loose])
            lower[loose, at[loose]] = _root_down(best[loose])
            worked += len(loose)
            rows = rows[~(lower[rows, c] > upper[rows]) & ~(half[c, at[rows]] > upper[rows])]
        if not len(rows):
            continue
        found = squared(x[rows], centroids[c : c + 1])
        worked += len(rows)
        lower[rows, c] = _root_down(found)
        nearer = (found < best[rows]) | ((found == best[rows]) & (c < at[rows]))
        moved = rows[nearer]
        at[moved], best[moved] = c, found[nearer]
        upper[moved] = _root_up(found[nearer])
    unknown = best < 0
    best[unknown] = squared(x[unknown], centroids[at[unknown]])
    return best, worked


def shifted(at: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Widen the bounds in place by how far the centroids moved."""
    moved = squared(old, new)
    far = _root_up(moved)
    far[moved == 0] = 0
    upper += far[at]
    upper[:] = np.where(far[at] > 0, np.nextafter(upper, _UP), upper)
    lower -= far
    lower[:] = np.maximum(np.where(far > 0, np.nextafter(lower, _DOWN), lower), np.float32(0))


def integers(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the integers, of the rows of ``vectors`` (``vec_id``,
    ``embedding``) that have ``dimensions`` components, none null or non-finite.

    Components whose integer lies outside plus or minus ``LARGEST`` have no
    squared distance that fits a long, so such rows are left out, too."""
    bad = lambda x: x.isNull() | F.isnan(x) | ~(F.abs(F.lit(scale) * x.cast("double")) < LARGEST)
    whole = (F.size("embedding") == dimensions) & ~F.exists("embedding", bad)
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", integers(F.col("embedding"), scale).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ``1:<vec_id>`` has the smallest SHA-256, in its order; rows that
    repeat an id follow by their components, a null id counts as empty. Fewer
    rows than ``clusters`` give fewer centroids."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in kept.orderBy(digest, "v").limit(clusters).select("v").collect()], np.int64)


def _floored(sums: list[int], n: int) -> list[int]:
    return [int(s) // n for s in sums]


STATE = "vec_id bigint, v array<int>, cluster int, distance bigint, upper float, lower array<float>, worked bigint"


def _passed(state: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """One round over the table of vectors: bounds are widened, vectors assigned."""
    k, dimensions = new.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(n, dimensions).astype(np.int64)
            if old is None:
                at, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
            else:
                at = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = b.column("upper").to_numpy(zero_copy_only=False).copy()
                lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, k).copy()
                shifted(at, upper, lower, old, new)
            distance, worked = assign(x, new, at, upper, lower)
            counts = np.zeros(n, np.int64)
            counts[0] = worked  # of the batch, on its first row
            lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), lower.ravel())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), v, pa.array(at, pa.int32()), pa.array(distance), pa.array(upper), lists, pa.array(counts)],
                names=["vec_id", "v", "cluster", "distance", "upper", "lower", "worked"],
            )

    return state.mapInArrow(step, STATE)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Assign the usable rows of ``vectors``, ``rounds`` times with new centroids after
    each, then once more.

    Returns a written table (``vec_id``, ``v``, ``cluster``, ``distance``: squared, ``upper``,
    ``lower``), the final centroids, and the number of distances that each pass
    worked out in its search (a plain search works out rows * clusters of them).
    A new centroid is the floor of the mean in each component; a cluster
    without vectors keeps its centroid. Ties go to the smaller number; rows that
    repeat count each for themselves; without usable rows there are no
    centroids and the table is empty. Other columns are ignored."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    kept = scratch.keep(usable(vectors, dimensions, scale), "integers")
    now, old, worked = first_centroids(kept, clusters), None, []
    if not len(now):
        return kept.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STATE.split(", ")[2:]))), now, []
    state = kept
    for turn in range(rounds + 1):
        state = scratch.keep(_passed(state, old, now), f"round_{turn}")
        sums = state.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.sum("worked").alias("worked"), F.array(*(F.sum(F.col("v")[i].cast("long")) for i in range(dimensions))).alias("sums")
        ).collect()  # a row a cluster
        scratch.free("integers" if turn == 0 else f"round_{turn - 1}")
        worked.append(sum(r.worked for r in sums))
        if turn < rounds:
            old, now = now, now.copy()
            for r in sums:
                now[r.cluster] = _floored(r.sums, r.n)
    return state, now, worked


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def clusters_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``
    for each usable row; see :func:`clustered` and :func:`usable`. A sum of
    distances that doesn't fit a long is null."""
    state, centroids, _ = clustered(vectors, clusters, rounds, dimensions, scale)
    of = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    names = state.sparkSession.createDataFrame(list(enumerate(digests(centroids))) or [(0, "")], "_cluster int, centroid_sha256 string")
    long = lambda c: F.col(c).try_cast("long")
    # a row a cluster on both sides
    whole = of.crossJoin(of.agg(F.sum("d").alias("all"))).join(names, F.col("cluster") == F.col("_cluster"))
    told = whole.select("_cluster", long("d").alias("cluster_inertia"), long("all").alias("inertia"), "centroid_sha256")
    return state.join(F.broadcast(told), F.col("cluster") == F.col("_cluster")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings`` in 16 clusters; rows that aren't usable have no row, repeated
    rows one each; an empty table gives no rows."""
    return clusters_of(documents(spark, sf_dir, "embeddings"))


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of :func:`op11_elkan_clusters`: all distances, without bounds."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (SELECT r, vec_id, v, unnest(best, recursive := true) FROM (SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v,
  min({{'distance': CAST({d} AS BIGINT), 'cluster': c.k}}) AS best FROM x, c{turn} c GROUP BY x.r))""")
        if turn < rounds:
            steps.append(f"""s{turn} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{turn}, range(1, 65) t(i) GROUP BY ALL),
n{turn} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{turn} GROUP BY cluster),
c{turn + 1} AS MATERIALIZED (SELECT c.k, CAST(coalesce(n.v, c.v) AS BIGINT[]) AS v FROM c{turn} c LEFT JOIN n{turn} n ON c.k = n.cluster)""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {clusters})),
{(',' + chr(10)).join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON cluster = c.k
"""
