import random

from evidentia.operators import graph, patterns
from hypothesis import given, settings
from hypothesis import strategies as st


def like(text, pattern):
    """LIKE of lower-cased texts, by recursion."""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    return bool(text) and (pattern[0] == "_" or pattern[0] == text[0]) and like(text[1:], pattern[1:])


def brute(symbols, asked):
    out = set()
    for e, s in symbols:
        for f, p, kind in asked:
            if e == f and None not in (s, p) and (p in s if kind == "contains" else like(s.lower(), p.lower())):
                out.add((e, s, p, kind))
    return out


def run(spark, symbols, asked):
    s = spark.createDataFrame(symbols, "engagement_id string, symbol string")
    p = spark.createDataFrame(asked, "engagement_id string, pattern string, kind string")
    return patterns.matches(s, p, ["engagement_id"])


def test_matches_brute_force(spark):
    r = random.Random(5)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    symbols = [(r.choice("ef"), word(r.randint(0, 9), "abAB.:é")) for _ in range(400)] + [("e", None), ("e", ""), ("e", "100%"), ("f", "a_b"), ("e", "İxK")]
    asked = [(r.choice("efg"), word(r.randint(0, 5), "abA:é"), "contains") for _ in range(60)] + [(r.choice("ef"), word(r.randint(1, 6), "abB%_:É"), "like") for _ in range(80)]
    asked += [("e", None, "like"), ("e", "%", "like"), ("f", "", "contains"), ("e", "_", "like"), ("e", "%k", "like"), ("e", "zzz", "contains"), ("e", "100%", "contains"), ("f", "%", "contains")]
    got = run(spark, symbols * 2, asked * 2)
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == brute(symbols, asked)


def test_no_pair_without_a_gram(spark):
    got = run(spark, [("e", "abc")], [("e", "abc", "contains"), ("e", "%", "like"), ("e", "a", "contains")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert run(spark, [], [("e", "a", "like")]).collect() == [] and run(spark, [("e", "a")], []).collect() == []


def test_seeds_and_sinks_as_the_lists_give(spark):
    edges = spark.createDataFrame([("a:f:Request.Args", "db.query"), ("a:f:args", "x.query()"), ("a:f:myargs", "std::fs::read"), ("p:$_GET", "reader")], "from_symbol string, to_symbol string")
    table = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")
    for sources in (["request.args"], ["$_GET", "args"], ["a", ""]):
        want = {tuple(r) for r in graph.seeds(edges, sources).collect()}
        assert {tuple(r) for r in patterns.seeds(edges, table(*sources)).collect()} == want
    symbols = edges.selectExpr("to_symbol AS symbol")
    for sinks in (["db.query"], ["std::fs::read", "zzz"], []):
        want = {r.symbol for r in symbols.where(graph.is_sink(symbols.symbol, sinks)).collect()}
        assert {r.symbol for r in patterns.holding(symbols, table(*sinks), leaves=True).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab%_", max_size=5), st.text("ab", max_size=6))
def test_like_of_the_test(pattern, text):
    import re

    assert like(text, pattern) == bool(re.fullmatch(pattern.replace("%", ".*").replace("_", "."), text))
