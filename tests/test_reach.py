import random
from collections import defaultdict

from evidentia.operators import graph
from evidentia.operators.reach import Graph, Reach
from pyspark.sql import functions as F

EDGE = "engagement_id string, from_symbol string, to_symbol string, edge_kind string, file_path string, line int"


def random_graph(seed=1, n=120, m=260, engagements=("e",)):
    r = random.Random(seed)
    return [(r.choice(engagements), f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice("ab"), "f.py", r.randrange(50)) for _ in range(m)]


def brute(edges, starts, is_sink, most):
    """(engagement, source, seed, symbol) -> (hops, parent edge, path), level by level."""
    out = defaultdict(list)
    for e, a, b, kind, file, line in edges:
        out[e, a].append((b, (a, line, kind, file)))
    rows = {}
    for e, source, seed in set(starts):
        seen, frontier = {seed: (0, None, [])}, [seed]
        for h in range(1, most + 1):
            met = defaultdict(list)
            for at in frontier:
                for b, edge in out[e, at]:
                    if b not in seen:
                        met[b].append(edge)
            for b, parents in met.items():
                best = min(parents)
                seen[b] = (h, best, seen[best[0]][2] + [(best[0], b, best[2], best[3], best[1])])
            frontier = [b for b in met if not is_sink(e, b)]
        rows |= {(e, source, seed, b): v for b, v in seen.items() if v[0]}
    return rows


def check(spark, edges, starts, sinks, most=12, by=("engagement_id",), **options):
    df = spark.createDataFrame(edges, EDGE)
    names = spark.createDataFrame(sorted(sinks), "engagement_id string, symbol string")
    g = Graph(df, names, list(by), **options)
    s = spark.createDataFrame(starts, "engagement_id string, source string, seed string")
    reach = Reach(g, s, most)
    want = brute(edges, starts, lambda e, x: (e, x) in sinks, most)
    sink = {k: v for k, v in want.items() if (k[0], k[3]) in sinks}
    assert sorted(map(tuple, reach.rows().collect())) == sorted((*k, v[0], k in sink) for k, v in want.items())
    parents = {(r.engagement_id, r.source, r.seed, r.symbol): (r.from_symbol, r.line, r.edge_kind, r.file_path) for r in reach.with_parents().collect()}
    assert parents == {k: v[1] for k, v in want.items()}
    pruned = Reach(g, s, most, toward_sinks=True)
    for one in (reach, pruned):
        assert sorted(map(tuple, one.sinks().collect())) == sorted((*k, v[0]) for k, v in sink.items())
    assert sum(t["n"] for t in pruned.told) <= sum(t["n"] for t in reach.told)
    got = {(r.engagement_id, r.source, r.seed, r.sink): [tuple(x) for x in r.edges] for r in pruned.chains().collect()}
    assert got == {k: v[2] for k, v in sink.items()}
    return g, reach


def test_reach_of_many_seeds_in_two_engagements(spark):
    """More seeds than a block of bits, symbols of one name in two engagements, buckets and hubs forced."""
    edges = random_graph(1, engagements=("e1", "e2"))
    starts = [(e, f"s{i % 3}", f"n{i}") for i in range(90) for e in ("e1", "e2")] + [("e1", "s0", "n0"), ("e3", "s0", "n1")]
    sinks = {("e1", f"n{i}") for i in range(0, 120, 9)} | {("e2", f"n{i}") for i in range(5, 120, 11)}
    check(spark, edges, starts, sinks, 4, hub=3, bucket=10)


def test_reach_on_edges_as_written(spark):
    check(spark, random_graph(2, 60, 130), [("e", "s", f"n{i}") for i in range(70)], {("e", f"n{i}") for i in range(0, 60, 7)}, 6)


def test_nothing_to_reach(spark):
    for edges, starts in (([], []), ([("e", "a", "b", "k", "f", 1)], []), ([], [("e", "s", "a")])):
        g = Graph(spark.createDataFrame(edges, EDGE), F.col("to_symbol") == "b", ["engagement_id"])
        reach = Reach(g, spark.createDataFrame(starts, "engagement_id string, source string, seed string"))
        assert reach.rows().count() == reach.chains().count() == reach.with_parents().count() == 0


def test_hub_of_a_million_edges(spark):
    """Edges of a hub are dealt to many tasks, and neither shuffled nor sorted when they are joined."""
    hub = spark.range(1_000_000).selectExpr("'hub' AS from_symbol", "CONCAT('leaf', id) AS to_symbol", "'a' AS edge_kind", "'f' AS file_path", "CAST(id % 7 AS INT) AS line")
    way = spark.createDataFrame([("start", "hub", "a", "f", 1), ("leaf77", "SINK", "a", "f", 2)], "from_symbol string, to_symbol string, edge_kind string, file_path string, line int")
    g = Graph(hub.unionByName(way), graph.is_sink(F.col("to_symbol"), ["SINK"]), hub=10_000, bucket=100_000)
    held, hubs = g.laid("from_symbol")
    assert hubs.collect()[0]["_parts"] == 100
    most = held.groupBy(F.input_file_name()).count().agg(F.max("count"), F.count(F.lit(1))).first()  # a file a bucket
    assert most[0] < 200_000 and most[1] > 8, most
    frontier = spark.createDataFrame([("start", 1)], "_at string, bits int")
    plan = g.joined(frontier, "from_symbol")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan, plan
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    above = [line for line in lines[:at] if line.index(line.lstrip(" :+-*()0123456789")) < lines[at].index("FileScan")]
    assert not any("Exchange" in line for line in above), plan  # nothing between the scan of edges and the join
    reach = Reach(g, spark.createDataFrame([("s", "start")], "source string, seed string"))
    assert [(r.sink, r.hops) for r in reach.sinks().collect()] == [("SINK", 3)] and [t["n"] for t in reach.told] == [1, 1_000_000, 1]
    assert [x.to_symbol for x in reach.chains().first().edges] == ["hub", "leaf77", "SINK"]


def test_distances_to_sinks(spark):
    edges = [(a, b, "k", "f", 1) for a, b in [("a", "b"), ("b", "S1"), ("a", "S2"), ("S1", "S2"), ("x", "a"), ("x", "x"), ("y", "z")]]
    g = Graph(spark.createDataFrame(edges, EDGE.split(", ", 1)[1]), graph.is_sink(F.col("to_symbol"), ["S1", "S2"]))
    assert {tuple(r) for r in g.to_sinks().collect()} == {("S1", 0), ("S2", 0), ("b", 1), ("a", 1), ("x", 2)}
    assert {tuple(r) for r in g.to_sinks(1).collect()} == {("S1", 0), ("S2", 0), ("b", 1), ("a", 1)}
