import hashlib
import math
import random

import numpy as np
from evidentia.llm import centroids
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3, scale=64):
    kept = [
        (i, [math.floor(scale * x) for x in map(float, np.float32(v))]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in named[:k]]
    for turn in range(rounds + 1):
        got = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, at) in zip(kept, got) if at == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    each = [sum(d for d, at in got if at == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((str(i), at, d, each[at], sum(each), sha[at]) for (i, _), (d, at) in zip(kept, got))


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(n=600, seed=3, spread=0.05):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, spread) for x in r.choice(middles)]) for i in range(n)]
    rows += [(n + i, list(rows[0][1])) for i in range(n // 3)]  # a common vector
    return rows + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]


def test_matches_brute_force(spark):
    rows = vectors()
    odd = [(9001, None), (9002, []), (9003, [0.1] * 63), (9004, [0.1] * 65), (9005, [0.1] * 63 + [None]), (9006, [0.1] * 63 + [float("nan")]), (9007, [0.1] * 63 + [float("inf")])]
    big = [(9008, [20000.0] + [0.0] * 63), (9009, [-20000.5] * 64)]
    docs = frame(spark, rows + odd + big).repartition(5)
    assert found(centroids.clusters_of(docs)) == brute(rows + odd + big)


def test_ties_go_to_the_smaller_number(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 1 / 64]) if j < 4 else 0.0 for j in range(64)]) for i in range(300)]
    assert found(centroids.clusters_of(frame(spark, rows).repartition(3))) == brute(rows)


def test_few_none_and_far_vectors(spark):
    rows = vectors(30)[:3]
    assert found(centroids.clusters_of(frame(spark, rows))) == brute(rows)
    assert found(centroids.clusters_of(frame(spark, []))) == []
    assert found(centroids.clusters_of(frame(spark, [(1, None)]))) == []
    far = (7, [3e38] + [0.0] * 63)
    assert found(centroids.clusters_of(frame(spark, [*rows, far]))) == brute(rows)


def test_bounds_skip_most_distances(spark):
    rows = vectors(2000, 5, 0.02)
    state, _, worked = centroids.clustered(frame(spark, rows))
    assert state.count() == len(rows) and len(worked) == 4
    assert all(w < 0.2 * 16 * len(rows) for w in worked[1:]), worked


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.sampled_from([2, 5, 1000, 1 << 27]))
def test_bounds_never_change_the_result(seed, k, size):
    """Rounds with bounds against all distances, with many ties and with large numbers."""
    r = np.random.default_rng(seed)
    x, c = r.integers(-size + 1, size, (40, 3)), r.integers(-size + 1, size, (k, 3))
    at, upper, lower = np.zeros(40, np.int64), np.full(40, np.inf, np.float32), np.zeros((40, k), np.float32)
    for _ in range(4):
        got, _ = centroids.assign(x, c, at, upper, lower)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (got == every.min(axis=1)).all()
        new = c.copy()
        for j in range(k):
            if (at == j).any():
                new[j] = x[at == j].sum(axis=0) // (at == j).sum()
        centroids.shifted(at, upper, lower, c, new)
        true = np.sqrt(((x[:, None] - new[None]) ** 2).sum(axis=2).astype(np.longdouble))
        assert (lower <= true).all() and (upper >= true[np.arange(40), at]).all()
        c = new
