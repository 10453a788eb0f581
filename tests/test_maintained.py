import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph
from evidentia.operators.maintained import MaintainedReach
from evidentia.operators.reach import Graph, Reach

EDGE = "eng string, from_symbol string, to_symbol string, edge_kind string, file_path string, line int"


def reach_by_hand(edges, starts, sink, most):
    """Breadth-first, one seed after the other."""
    out = set()
    for eng, source, seed in starts:
        seen, level = {seed}, [seed]
        for h in range(1, most + 1):
            found = {t for e, f, t in edges if e == eng and f in level} - seen
            out |= {(eng, source, seed, t, h, sink(t)) for t in found}
            seen |= found
            level = [t for t in found if not sink(t)]
    return out


def kept(spark, root, most=12):
    def seeds_of(edges):
        return edges.where(F.col("from_symbol").startswith("s")).select("eng", F.lit("src").alias("source"), F.col("from_symbol").alias("seed")).distinct()

    return MaintainedReach(spark, root, seeds_of, lambda s: s.endswith("7"), ["eng"], most, buckets=8)


def frame(spark, edges):
    return spark.createDataFrame([(e, f, t, "assign", "f", 1) for e, f, t in edges], EDGE)


def graph_of(rng, n, names):
    return [(rng.choice(["a", "b"]), rng.choice(names), rng.choice(names)) for _ in range(n)]


def test_batches_equal_one_traversal(spark, tmp_path):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(90)] + [f"s{i}" for i in range(8)]
    edges = graph_of(rng, 260, names)
    # a long way first, short cuts later, edges that repeat, a self loop, a way back to a seed
    first = [("a", "s0", "c1"), *(("a", f"c{i}", f"c{i + 1}") for i in range(1, 7)), *edges[:120]]
    batches = [first, edges[100:200] + [("a", "c1", "c4"), ("a", "c1", "c1"), ("a", "c4", "s0")], edges[200:] + [("a", "s0", "c5")]]
    m = kept(spark, str(tmp_path / "reach"), 6)
    told = [m.insert(frame(spark, b)) for b in batches]
    everything = {e for b in batches for e in b}
    starts = {(e, "src", f) for e, f, _ in everything if f.startswith("s")}
    want = reach_by_hand(everything, starts, lambda t: t.endswith("7"), 6)
    got = [tuple(r) for r in m.rows().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(t["edges"] for t in told) == len(everything) and sum(t["seeds"] for t in told) == len(starts)
    # as of an earlier version
    early = set(first)
    assert {tuple(r) for r in m.rows(1).collect()} == reach_by_hand(early, {(e, "src", f) for e, f, _ in early if f.startswith("s")}, lambda t: t.endswith("7"), 6)


def test_nothing_new_writes_nothing(spark, tmp_path):
    m = kept(spark, str(tmp_path / "reach"))
    assert m.rows().count() == 0
    edges = [("a", "s1", "x"), ("a", "x", "y7"), ("a", "y7", "z")]
    assert m.insert(frame(spark, edges)) == {"edges": 3, "seeds": 1, "rows": 3}
    assert m.insert(frame(spark, edges)) == {"edges": 0, "seeds": 0, "rows": 0}
    assert m.insert(frame(spark, []))["rows"] == 0
    odd = spark.createDataFrame([("a", None, "q", "k", "f", 1), ("a", "x", None, "k", "f", 1)], EDGE)
    assert m.insert(odd.withColumn("bits", F.lit(1)).withColumn("version", F.lit(9)))["edges"] == 0
    assert sorted(tuple(r)[3:] for r in m.rows().collect()) == [("x", 1, False), ("y7", 2, True)]


def test_a_run_that_was_lost_is_passed_over(spark, tmp_path, monkeypatch):
    m = kept(spark, str(tmp_path / "reach"))
    m.insert(frame(spark, [("a", "s1", "x")]))
    log = MaintainedReach._log

    def lost(self, rows, version, hops):
        told = log(self, rows, version, hops)
        if hops == 2:
            raise RuntimeError("lost")
        return told

    monkeypatch.setattr(MaintainedReach, "_log", lost)
    more = frame(spark, [("a", "x", "y"), ("a", "y", "z")])
    with pytest.raises(RuntimeError):
        m.insert(more)
    assert [r.symbol for r in m.rows().collect()] == ["x"]
    monkeypatch.undo()
    m.insert(more)
    assert sorted((r.symbol, r.hops) for r in m.rows().collect()) == [("x", 1), ("y", 2), ("z", 3)]


def test_same_as_the_traversal_at_the_limit(spark, tmp_path):
    rng = random.Random(8)
    edges = list(set(graph_of(rng, 150, [f"n{i}" for i in range(60)] + ["s1", "s2"])))
    m = kept(spark, str(tmp_path / "reach"), most=3)
    for at in range(2):
        m.insert(frame(spark, edges[at::2]))
    whole = frame(spark, edges)
    starts = whole.where("from_symbol LIKE 's%'").select("eng", F.lit("src").alias("source"), F.col("from_symbol").alias("seed"))
    want = Reach(Graph(whole, F.col("to_symbol").endswith("7"), ["eng"]), starts, 3).rows()
    cols = ["eng", "source", "seed", "symbol", "hops", "is_sink"]
    assert sorted(map(tuple, m.rows().select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
