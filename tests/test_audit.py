import json
import math

import pytest
from evidentia.operators import crosswalk, dedup, dependencies, graph, intervals, jobs, journal, mutate, policy, report, rollups, text, triage, vector
from evidentia.operators.normalize import suppress_lit
from evidentia.functions import scalars as S
from evidentia.schemas import TABLES
from pyspark.sql import functions as F

EDGE = "from_symbol string, to_symbol string, edge_kind string, file_path string, line int"
FINDING = "engagement_id string, id string, severity string, cwe string, file_path string, line_start int, line_end int, title string, description string, tool_origin string, status string, advocate_verdict string, poc_status string"
NO_SYMBOLS = ([], "file_path string, line_start int, line_end int, kind string, name string")


def edge_table(spark, *rows):
    return spark.createDataFrame([(a, b, "assign", "a.py", n) for n, (a, b) in enumerate(rows, 1)], EDGE)


def finding(i, severity="high", **kw):
    row = {"engagement_id": "e", "id": i, "severity": severity, "cwe": "CWE-89", "file_path": "src/a.py", "line_start": 1, "line_end": 2, "title": "t", "description": "d", "tool_origin": "x", "status": "open", "advocate_verdict": None, "poc_status": None} | kw
    return tuple(row[c.split()[0]] for c in FINDING.split(", "))


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, line int, content string")


def test_two_hop_chain_and_cycle(spark):
    e = edge_table(spark, ("a.py:f:request.args", "a.py:f:q"), ("a.py:f:q", "a.py:f:cursor.execute"), ("a.py:f:q", "a.py:f:r"), ("a.py:f:r", "a.py:f:q"))
    got = graph.taint_chains(e, ["request.args"], ["cursor.execute"], [], spark.createDataFrame(*NO_SYMBOLS), lines(spark, ("a.py", 1, "x")), "01234567-89").collect()
    assert len(got) == 1 and got[0].id == "TC-01234567-0001" and got[0].sanitizers_seen == ["unguarded"] and got[0].source_line == 1 and got[0].sink_line == 2
    assert [h.propagation_reason for h in got[0].chain] == ["assign: a.py:f:request.args -> a.py:f:q", "assign: a.py:f:q -> a.py:f:cursor.execute"]
    loop = edge_table(spark, ("s", "b"), ("b", "s"))
    assert graph.traverse(loop, graph.seeds(loop, ["s"]), ["zzz"]).where("is_sink").count() == 0


def test_chain_length_cap_and_sink_test(spark):
    e = edge_table(spark, *((f"n{i}", f"n{i + 1}") for i in range(14)), ("sink", "n0"))
    for most, want in ((12, 12), (3, 3)):
        reached = graph.traverse(e, graph.seeds(e, ["n0"]).where("seed = 'n0'"), ["n13"], most)
        assert reached.agg(F.max("hops")).first()[0] == want
    s = graph.seeds(e, ["sink"])
    assert not graph.traverse(e, s, ["sink"]).where("is_sink").count()  # the seed is not tested
    at_cap = graph.traverse(e, graph.seeds(e, ["n0"]).where("seed = 'n0'"), ["n12"])
    assert [r.hops for r in at_cap.where("is_sink").collect()] == [12] and at_cap.where("symbol = 'n13'").count() == 0


def test_guards_on_path_and_in_scope(spark):
    e = edge_table(spark, ("a.py:f:src", "a.py:f:authorize"), ("a.py:f:authorize", "a.py:f:sink"))
    args = ["src"], ["sink"]
    no = spark.createDataFrame(*NO_SYMBOLS)
    assert graph.taint_chains(e, *args, ["authorize"], no, lines(spark, ("b", 1, "x")), "e").first().sanitizers_seen == []
    e = spark.createDataFrame([("f:src", "f:sink", "assign", "a.py", 50)], EDGE)
    run = lambda symbols, *at: graph.taint_chains(e, *args, ["Check("], symbols, lines(spark, *(("a.py", n, "Check(x)") for n in at)), "e").first().sanitizers_seen
    assert run(no, 10) == [] and run(no, 58) == [] and run(no, 9) == ["unguarded"] and run(no, 59) == ["unguarded"]
    two = spark.createDataFrame([("a.py", 45, 55, "function", "g"), ("a.py", 20, 44, "function", "sibling"), ("a.py", 1, 99, "class", "C")], NO_SYMBOLS[1])
    assert run(two, 39) == ["unguarded"] and run(two, 40) == [] and run(two, 56) == ["unguarded"] and run(two, 55) == []
    files = spark.createDataFrame([("a.py", "x\nCheck(1)"), ("big.py", "Check(" * 800_000), ("c.py", None)], "path string, text string")
    assert {(r.file_path, r.line) for r in graph.file_lines(files).collect()} == {("a.py", 1), ("a.py", 2)}


def test_seed_and_sink_forms(spark):
    e = edge_table(spark, ("a:f:Request.Args", "x"), ("a:f:args", "x"), ("a:f:myargs", "x"))
    assert sorted(r.seed for r in graph.seeds(e, ["request.args"]).collect()) == ["a:f:Request.Args", "a:f:args"]
    assert graph.expanded_sinks(["std::fs::read", "db.query"]) == ["db.query", "query", "read", "std::fs::read"]


def test_bfs_is_shortest(spark):
    """A long branch cannot hide a short chain."""
    e = edge_table(spark, *((("s" if i == 0 else f"l{i}"), f"l{i + 1}") for i in range(11)), ("l11", "m"), ("s", "a"), ("a", "m"), ("m", "SINK"))
    got = graph.chains(graph.traverse(e, graph.seeds(e, ["s"]).where("seed = 's'"), ["SINK"])).collect()
    assert [(r.hops, [x.to_symbol for x in r.edges]) for r in got] == [(3, ["a", "m", "SINK"])]


def test_pages_concatenate_to_the_whole_order(spark):
    rows = [finding(f"F-{i:03d}", S.SEVERITIES[i % 5], file_path=".github/x" if i % 7 == 0 else "src/x") for i in range(95)]
    f = spark.createDataFrame(rows, FINDING)
    pages = [r.id for n in range(5) for r in triage.prioritised(f, "low", n, 20).collect()]
    want = [r[1] for r in sorted((r for r in rows if not r[4].startswith(".github") and r[2] != "info"), key=lambda r: (-S.RANKS.get(r[2], 0), r[1]))]
    assert pages == want
    env = triage.envelope(triage.compact(f), triage.by_priority(), 3, 30, prioritised=True).first()
    assert (env.page, env.page_size, env.total, env.returned, env.has_more, env.prioritised) == (3, 30, 95, 5, False, True) and len(env.rows) == 5
    assert [r.id for r in triage.envelope(triage.compact(f), triage.by_priority(), 0, 10).first().rows] == [r.id for r in triage.page(f, triage.by_priority(), 0, 10).collect()]
    assert triage.page_bounds(None, None) == (0, 30, 0) and triage.page_bounds(2, 500) == (2, 100, 200) and triage.page_bounds(1, 0) == (1, 1, 1)


def test_tier_order(spark):
    rows = [("3", "src/a.py", ["unguarded"]), ("2", "src/b_test.py", ["unguarded"]), ("1", "src/c.py", []), ("0", "scripts/d.py", ["unguarded"])]
    c = spark.createDataFrame(rows, "id string, sink_file string, sanitizers_seen array<string>")
    assert [r.id for r in triage.page(c, triage.by_tier()).collect()] == ["3", "0", "2", "1"]


def test_dedup_first_wins_and_idempotent(spark):
    raw = spark.createDataFrame([("a", 1, "r1", "CWE-1", 0, 5), ("a", 1, "r2", "CWE-1", 1, 0), ("a", 1, "r2", None, 2, 0), ("a", 0, "r1", "CWE-1", 3, 0), ("a", 0, "r2", "CWE-1", 4, 0)], "file_path string, line_start int, rule_id string, cwe string, job int, pos int")
    once = dedup.cross_tool_dedup(raw, ["job", "pos"])
    assert sorted(r.job for r in once.collect()) == [0, 2, 3, 4]
    assert sorted(map(tuple, dedup.cross_tool_dedup(once, ["job", "pos"]).collect())) == sorted(map(tuple, once.collect()))
    new = dedup.new_rows(raw, raw.where("job = 3"), ["file_path", "line_start"], ["job"])
    assert [(r.line_start, r.job) for r in new.collect()] == [(1, 0)]


HANDOFF = [("confirmed", None, "high", [], True), ("uncertain", None, "high", [], False), ("uncertain", None, "high", ["analyzer"], True), ("uncertain", "reproduced", "high", ["code"], True), ("uncertain", "reproduced_by_citation", "high", [], False), ("confirmed", "refuted", "high", ["analyzer"], False), ("confirmed", None, "low", ["analyzer"], False), ("confirmed", None, "info", [], False), (None, "reproduced", "critical", ["analyzer"], False), ("rebutted", None, "high", ["analyzer"], False)]


def test_handoff_truth_table(spark):
    df = spark.createDataFrame([(i, v, p, s, c) for i, (v, p, s, c, _) in enumerate(HANDOFF)], "n int, advocate_verdict string, poc_status string, severity string, citations array<string>")
    got = {r.n: r for r in policy.handoff_gate(df).collect()}
    assert [got[i].allowed for i in range(len(HANDOFF))] == [x[-1] for x in HANDOFF]
    assert got[5].reasons == ["handoff-not-refuted"] and got[0].reasons == ["handoff-permits-reporter"]


def test_rules(spark):
    rows = [("static_hunter", "execute_tool", "Audit::StaticHunter", None, None, True), ("static_hunter", "execute_tool", "Audit::RepoIntel", None, None, False), ("cartographer", "write", None, "routes", None, True), ("cartographer", "write", None, "findings", None, False), ("reflector", "recall_journal", None, None, None, True), ("reflector", "write", None, "routes", None, False), ("audit-controller", "network", None, None, "token", False), ("nobody", "dance", None, None, None, False)]
    df = spark.createDataFrame([(*r[:5], i) for i, r in enumerate(rows)], "principal string, action string, type string, table string, step_up_token string, n int")
    assert [r.allowed for r in policy.authorise(df).orderBy("n").collect()] == [r[-1] for r in rows]
    f = spark.createDataFrame([(["code"], "env", "h", True), ([], "env", "h", False), (["code"], "", "h", False), (["code"], "env", None, False), (["poc"], "env", "h", False)], "citations array<string>, evidence_envelope_id string, specifier_hash string, want boolean")
    assert all(r.allowed == r.want for r in policy.store_gate(f).collect()) and not any(r.allowed for r in policy.store_gate(f, "reflector").collect())
    v = spark.createDataFrame([("rebutted", "because", ["sanitizer"], True), ("rebutted", " ", ["sanitizer"], False), ("rebutted", "x", ["rumour"], False), ("confirmed", None, None, True)], "verdict string, reason string, witness_types array<string>, want boolean")
    assert all(r.allowed == r.want for r in policy.rebuttal_gate(v).collect())


def test_poc_status(spark):
    f = spark.createDataFrame([finding(str(i)) for i in range(6)], FINDING)
    asked = spark.createDataFrame([("e", "0", "reproduced"), ("e", "1", "reproduced"), ("e", "2", "refuted"), ("e", "3", "refuted"), ("e", "4", "odd"), ("e", "5", "inconclusive")], "engagement_id string, id string, new_status string")
    made = mutate.exhibits(spark.createDataFrame([("e", "0", "{}"), ("other", "1", "{}")], "engagement_id string, finding_id string, exhibit string"))
    assert made.columns == [c.split()[0] for c in TABLES["finding_citations"].split(", ")] and made.first().intended_poc == "{}"
    cites = made.unionByName(mutate.citation_rows(spark.createDataFrame([("e", "1", "code", "a.py", "h")], "engagement_id string, finding_id string, citation_type string, code_path string, hypothesis_id string")))
    assert cites.where("citation_type = 'code'").first().code_path == "a.py" and cites.where("citation_type = 'code'").first().hypothesis_id is None
    runs = spark.createDataFrame([("2", 1, True, True, None, 0, False), ("2", 2, False, True, None, 0, False), ("3", 1, False, True, None, 1, False)], "finding_id string, at int, timed_out boolean, ok boolean, error string, exit_code int, reproduced boolean")
    got = {r.id: (r.status, r.poc_status, r.mutation_error) for r in mutate.set_poc_status(f, asked, cites, runs).collect()}
    assert got == {"0": ("open", "reproduced", None), "1": ("open", None, "no exhibit"), "2": ("hypothesis", "refuted", None), "3": ("open", None, "last run was environmental"), "4": ("open", None, "unknown status"), "5": ("open", "inconclusive", None)}
    assert triage.proof_candidates(f).count() == 6
    new = spark.createDataFrame([("e", "0", "confirmed", 1), ("e", "0", "rebutted", 3), ("e", "0", "uncertain", 2), ("x", "1", "confirmed", 1)], "engagement_id string, id string, verdict string, at int")
    after = mutate.set_verdicts(f, new).collect()
    assert len(after) == 6 and {r.id: r.advocate_verdict for r in after} == {"0": "rebutted", **{str(i): None for i in range(1, 6)}}
    twice = asked.unionByName(asked)
    assert mutate.set_poc_status(f, twice, cites, runs).count() == 6


def test_chain_nodes_triples_models(spark):
    c = spark.createDataFrame([("0123-456789", 1, "gate_evasion", ["F1", "F2"], " "), ("e", 2, "unknown", ["F1"], "r")], "engagement_id string, chain_no int, stage string, finding_ids array<string>, rationale string")
    assert [(r.id, r.finding_id, r.next_chain_id, r.rationale) for r in mutate.chain_nodes(c).orderBy("id").collect()] == [("AC-01234567-0001-001", "F1", "AC-01234567-0001-002", "step 1"), ("AC-01234567-0001-002", "F2", None, "step 2")]
    t = spark.createDataFrame([("a", "b", "c", 1.5), ("a", " ", "c", 0.1), ("a", "b", "c", -1.0)], "subject string, predicate string, object string, confidence double")
    assert sorted(r.confidence for r in mutate.triples(t).collect()) == [0.0, 1.0]
    m = mutate.pinned_model(spark.createDataFrame([(["b"], ["a"])], "sources array<string>, sinks array<string>"), ["sources", "sinks"])
    assert m.first().json == '{"sinks":["a"],"sources":["b"]}' and mutate.verified_model(m).first().hash_ok
    files = spark.createDataFrame([("src/a.py",)], "path string")
    rows = spark.createDataFrame([("src/a.py", ["code"], "v", "h"), ("src/b.py", ["code"], "v", "h"), ("src/a.py", [], "v", "h"), ("src/a.py", ["rumour"], "v", "h"), ("src/a.py", ["code"], "", "h")], "file_path string, citations array<string>, evidence_envelope_id string, specifier_hash string")
    errors = [r.mutation_error for r in mutate.validated_findings(rows, files).collect()]
    assert sorted(map(str, errors)) == ["None", "file not found", "no citations", "store-needs-envelope", "unknown citation type"]
    proofs = spark.createDataFrame([("p", 0, "a", 1, 2, "one\ntwo"), ("p", 1, "a", 2, 2, "two"), ("q", 0, "a", 1, 1, "two"), ("r", 0, "none", 1, 1, "x")], "proof_id string, cite int, file_path string, line_start int, line_end int, expected string")
    got = {r.proof_id: r.holds for r in mutate.cited_source_holds(proofs, lines(spark, ("a", 1, "one"), ("a", 2, "two"))).collect()}
    assert got == {"p": True, "q": False, "r": False}


def test_journal(spark, tmp_path):
    path = f"{tmp_path}/j.jsonl"
    for i in range(3):
        journal.append(path, [{"timestamp": f"2024-01-0{i + 1}T00:00:00Z", "principal": "p", "action": "aé", "resource": "r|\"x\"", "cedar_decision": "permit"}])
    verdict = lambda: journal.verify(spark, path).first()
    assert (verdict().first_bad, verdict().n_valid) == (None, 3)
    good = open(path).read().split("\n")
    assert json.loads(good[0])["prev_hash"] == journal.GENESIS
    open(path, "w").write("\n".join([good[0], "", good[1].replace('"permit"', '"deny"'), good[2], ""]))
    assert (verdict().first_bad, verdict().n_valid) == (2, 1)
    open(path, "w").write("\n".join([good[0], "junk", good[1]]))
    assert verdict().first_bad == 1 and journal.read_lenient(spark, path).count() == 2
    open(path, "w").write("\n".join([good[0], good[2]]))
    assert (verdict().first_bad, verdict().n_valid) == (1, 1)
    assert journal.embedding_text(journal.read_lenient(spark, path)).first().text.startswith("p aé")


def test_vectors(spark, tmp_path):
    embed = vector.byte_embedder(8)
    rows = spark.createDataFrame([(f"c{i}", "e" if i % 2 else "f", f"text {i}") for i in range(20)], "id string, engagement_id string, text string")
    coll = vector.Collection(spark, f"{tmp_path}/v", 8)
    coll.insert(vector.indexed(rows, "chunk", embed, 8))
    with pytest.raises(ValueError):
        vector.Collection(spark, f"{tmp_path}/w", 9).insert(vector.indexed(rows, "chunk", embed, 8))
    hits = vector.nearest(coll.read(), embed(["text 7"])[0], 3, F.col("engagement_id") == "e")
    got = vector.decoded(hits, "id string, text string").collect()
    assert got[0].text == "text 7" and got[0].distance < 1e-12 and len(got) == 3
    queries = coll.read().where("id in ('c1', 'c5')").select(F.col("id").alias("query_id"), "vector")
    each = vector.nearest_each(coll.read(), queries, 2, 8).collect()
    assert {(r.query_id, r.id) for r in each if r["rank"] == 0} == {("c1", "c1"), ("c5", "c5")} and len(each) == 4


def test_text_rules(spark):
    t = "import os\n  from a import b\nx = 1\ndef f():\n    pass\n"
    df = spark.createDataFrame([(t,), ("é" * 3000,), ("",)], "text string")
    got = df.select(text.line_range(F.col("text"), 2, 3).alias("r"), text.import_lines(F.col("text")).alias("i"), S.cut_bytes(F.col("text"), 4095).alias("c"), text.body(F.col("text"), F.lit(4), F.lit(99)).alias("b")).collect()
    assert got[0].r == "2:   from a import b\n3: x = 1" and got[0].i == ["import os", "from a import b"] and got[0].b == "def f():\n    pass"
    assert got[1].c == "é" * 2047 and got[2].c == ""
    for s in ["a" * 10, "aé" * 5, "日本語" * 3, "a😀" * 3]:
        for n in range(1, 12):
            want = s.encode()[:n].decode("utf8", "ignore")
            assert spark.createDataFrame([(s,)], "t string").select(S.cut_bytes(F.col("t"), n)).first()[0] == want, (s, n)
            if len(s) > 6:
                break
    symbols = spark.createDataFrame([("a.py", 4, 5, "function", "f", "python")], "file_path string, line_start int, line_end int, kind string, name string, language string")
    files = spark.createDataFrame([("a.py", "python", t), ("b.go", "go", "package b\n"), ("c.py", "python", " \n")], "path string, language string, text string")
    assert sorted((r.id, r.text) for r in text.chunks(files, symbols).collect()) == [("a.py:4-5", "def f():\n    pass"), ("b.go:1-1", "package b\n")]
    ctx = text.context(spark.createDataFrame([("a.py", 5), ("a.py", 1)], "file string, line int"), symbols, files).orderBy("line").collect()
    assert ctx[0].name is None and ctx[1].name == "f" and ctx[1].imports == ["import os", "from a import b"]


def test_scalars(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(S.leaf, "a.b::c") == "c" and one(S.without_root, "/repo/x") == "x" and one(S.line_range, "42-x") == (42, 42) and one(S.digits, "CWE_89") == "89"
    assert one(S.split_requirement, "a[x]>=1,==2 # c") == ("a[x]>=1,", "==2") or one(S.split_requirement, "a[x]>=1,==2 # c").name.startswith("a")
    assert one(S.split_requirement, "flask==2.0") == ("flask", "==2.0") and one(S.split_requirement, "requests") == ("requests", "") and one(S.split_requirement, "u~=1") == ("u", "~=1")
    assert one(S.known_severity, "ODD") == "info" and one(S.known_confidence, "High") == "high" and one(S.risk_priority, "medium") == ("moderate", "moderate")
    assert one(S.canonical_model, "openrouter/a/claude-x.5") == "claude-x-5" and one(S.tier, "p:m:x") == ("p", "m:x")
    assert spark.range(1).select(S.minted_id(F.lit("F"), F.lit(7)), S.minted_id(F.lit("F"), F.lit(12345))).first()[:] == ("F-0007", "F-12345")


def test_jobs_counts(spark):
    for langs, n in ((["python"], 5), (["rust"], 4), (["python", "rust"], 9), (["typescript", "javascript"], 4), (["go"], 3), (["java"], 2), (["iac"], 2), (["php"], 3), (["cobol"], 0)):
        df = spark.createDataFrame([("e", x) for x in langs], "engagement_id string, language string")
        assert jobs.select_jobs(df).count() == n, langs
    facts = spark.createDataFrame([("e", "language", '{"name":"go"}'), ("e", "framework", '{"name":"gin"}')], "engagement_id string, kind string, json string")
    assert [r.language for r in jobs.detected_languages(facts).collect()] == ["go"]


def test_dependency_merge(spark):
    d = spark.createDataFrame([("a", "==1", "requirements.txt", 0, 3), ("a", "==2", "Pipfile", 2, 0), ("b", "", "pyproject.toml", 1, 0)], "name string, version_spec string, source_file string, precedence int, ordinal int")
    lock = spark.createDataFrame([("a", "1.0", "poetry.lock"), ("c", "3", "poetry.lock")], "name string, version string, source_file string")
    assert sorted(map(tuple, dependencies.merge(d, lock).collect())) == [("a", "==1", "1.0", "requirements.txt", "direct"), ("b", "", None, "pyproject.toml", "direct"), ("c", "", "3", "poetry.lock", "transitive")]


def test_runs_of_one_engagement_do_not_judge_another(spark):
    f = spark.createDataFrame([("e1", "F1", "open", None), ("e2", "F1", "open", None)], "engagement_id string, id string, status string, poc_status string")
    asked = spark.createDataFrame([("e1", "F1", "refuted"), ("e2", "F1", "refuted")], "engagement_id string, id string, new_status string")
    cites = spark.createDataFrame([], "engagement_id string, finding_id string, citation_type string")
    runs = spark.createDataFrame([("e1", "F1", 1, True, True, None, 0, False)], "engagement_id string, finding_id string, at int, timed_out boolean, ok boolean, error string, exit_code int, reproduced boolean")
    got = {r.engagement_id: (r.poc_status, r.mutation_error) for r in mutate.set_poc_status(f, asked, cites, runs).collect()}
    assert got == {"e1": (None, "last run was environmental"), "e2": ("refuted", None)}


def test_dyadic_pieces(spark):
    rows = [(a, b) for a in range(-9, 20) for b in range(-10, 40)] + [(0, 10**9), (-(2**31), 2**31 - 1), (5, None), (None, 5)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", intervals.pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        if r.a is None or r.b is None or r.b < r.a:
            assert not r.p
            continue
        assert len(r.p) <= 2 * max(1, math.log2(r.b - r.a + 1)) + 1
        spans = sorted((x.at << x.level, ((x.at + 1) << x.level) - 1) for x in r.p)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_long_spans_and_crowded_lines(spark):
    """A span of 10^9 lines is a few pieces; a line with most of the points is one probe."""
    spans = [("a", 1, 10**9, "class", "all"), ("a", 1, 2**31 - 1, "function", "bad_end"), ("a", 7, 7, "method", "m"), ("b", 5, 4, "function", "inverted"), (None, 1, 9, "function", "none")]
    symbols = spark.createDataFrame(spans, "file_path string, line_start int, line_end int, kind string, name string")
    points = spark.range(200_000).selectExpr("id", "'a' AS file", "IF(id < 199990, 7, CAST(id * 5000 AS INT)) AS line").unionByName(spark.createDataFrame([(-1, "b", 5), (-2, None, 1), (-3, "a", None), (-4, "a", 0)], "id long, file string, line int"))
    inner = intervals.enclosing_function(points, symbols, ["id"]).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in inner} == {"m": 199_990, "bad_end": 10}
    small = intervals.smallest_symbol(points, symbols, ["id"]).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in small} == {"m": 199_990, "all": 10}
    pairs = intervals.contained(points.where("id >= 199990"), symbols, "file", "line")
    assert pairs.count() == 20 and "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in intervals.holding(symbols, points.where("line > 7"), "file", "line").collect()) == ["all", "bad_end"]


def test_intervals_across_blocks(spark):
    spans = spark.createDataFrame([("a", 1, 500, "class", "C"), ("a", 60, 70, "function", "f"), ("a", 63, 200, "method", "m"), ("b", 1, 9, "function", "g")], "file_path string, line_start int, line_end int, kind string, name string")
    points = spark.createDataFrame([("a", n) for n in (1, 63, 64, 128, 300)], "file string, line int")
    inner = {r.line: r.name for r in intervals.enclosing_function(points, spans, ["file", "line"]).collect()}
    small = {r.line: r.name for r in intervals.smallest_symbol(points, spans, ["file", "line"]).collect()}
    assert inner == {63: "m", 64: "m", 128: "m"} and small == {1: "C", 63: "f", 64: "f", 128: "m", 300: "C"}


def test_rollups(spark):
    f = spark.createDataFrame([finding("a", "low", advocate_verdict="confirmed"), finding("b", "critical", poc_status="refuted")], FINDING)
    assert [r.severity for r in rollups.severity_buckets(f).collect()] == ["critical", "low"]
    c = spark.createDataFrame([("a", "code"), ("a", "code"), ("a", "analyzer")], "finding_id string, citation_type string")
    assert {r.id: r.citations for r in rollups.citation_types(f, c).collect()} == {"a": ["analyzer", "code"], "b": []}
    steps = spark.createDataFrame([("k", i, "store" if i == 3 else "read") for i in range(12)], "k string, n int, action string")
    assert [r.reads_since_store for r in rollups.reads_since_store(steps, "k", ["n"]).orderBy("n").collect()] == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert math.isclose(rollups.cost_rollup(spark.createDataFrame([("k", 1_000_000, 2_000_000)], "k string, input_tokens long, output_tokens long"), "k").first().est_cost, 33.0)
    chains = spark.createDataFrame([("e", ["unguarded"]), ("e", []), ("e", None)], "engagement_id string, sanitizers_seen array<string>")
    assert rollups.guard_totals(chains).first()[1:] == (1, 2)


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([finding("F-2", "low", advocate_verdict="confirmed"), finding("F-1", "critical", advocate_verdict="confirmed", cwe=None)], FINDING)
    doc = json.loads(report.sarif(f).first().sarif)
    assert doc["version"] == "2.1.0" and [r["ruleId"] for r in doc["runs"][0]["results"]] == ["F-1", "F-2"] and [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"]
    cites = spark.createDataFrame([("F-1", "code")], "finding_id string, citation_type string")
    seeds = {r.id: r for r in report.seed(f, cites).collect()}
    assert seeds["F-1"].allowed and json.loads(seeds["F-1"].entry)["citations"] == ["code"] and seeds["F-2"].entry is None and seeds["F-2"].reasons == ["handoff-least-severity"]
    nodes = spark.createDataFrame([("e", "gate_evasion")], "engagement_id string, stage string")
    md = report.markdown(f, nodes, "e")
    assert md.index("## Critical (1)") < md.index("## Low (1)") and "gate_evasion: 1 nodes" in md
    signed = report.signed({"b": 1, "a": [2]}, lambda body: str(len(body)))
    assert report.verified(signed) and report.verified(signed, lambda body, s: s == str(len(body))) and not report.verified(signed | {"b": 2})
    folder = report.write(str(tmp_path), "e", {"a.md": md})
    assert (tmp_path / "e" / "latest" / "a.md").read_text() == md and folder.endswith("Z")
    docs = spark.createDataFrame([("S-1", "t", '{"a":1}'), ("S-1", "t", "text")], "scan_id string, tool string, raw string")
    for r in report.evidence(docs, str(tmp_path / "ev")).collect():
        assert (tmp_path / "ev" / f"{r.envelope_id}.json").exists() and r.envelope_id.startswith("S-1-t-") and len(r.envelope_id) == 18
    paid = {t: [json.loads(r.payload) for r in crosswalk.payloads(f, t).collect()] for t in crosswalk.TARGETS}
    assert paid["gapps"] == [{"title": "t", "description": "d", "status": "new", "risk": "low", "priority": "low"}]
    assert paid["comp"] == [{"title": "t", "description": "d", "category": "technology", "status": "open"}]
    assert crosswalk.tagged(f).first().tags[:3] == ["nist_800_53:SI-10", "nist_800_53:SI-15", "owasp_asvs:V5.3.4"]
    assert crosswalk.unmapped(f).first().reason == "no cwe"


def _documents_are_read_back_part_by_part(spark, f):
    parts = report.sarif_parts(f, rows=40)
    assert "Window" not in parts._jdf.queryExecution().executedPlan().toString()  # no task gets the texts of a document
    read = report.sarif_from_parts(parts)
    assert "collect_list" not in read._jdf.queryExecution().executedPlan().toString()
    found = read.select("engagement_id", "place", "result.ruleId", "result.level").collect()
    for e, mine in (("e", 233), ("other", 117)):
        whole = json.loads(report.sarif(f).where(F.col("engagement_id") == e).first().sarif)["runs"][0]["results"]
        assert len(whole) == mine and sorted(tuple(r)[1:] for r in found if r.engagement_id == e) == [(i, r["ruleId"], r["level"]) for i, r in enumerate(whole)]
    rows = sorted((r for r in parts.collect() if r.engagement_id == "e"), key=lambda r: r.part)
    assert [r.part for r in rows] == list(range(len(rows)))
    for broken in (rows[1:], rows[:-1], rows[:-2] + rows[-1:], [r for r in rows if r.text != report.SARIF_BETWEEN], [r if r.part != 2 else r.asDict() | {"text": r.text[:-1]} for r in rows]):
        with pytest.raises(Exception):
            report.sarif_from_parts(spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in broken], parts.schema)).collect()


def test_whole_reports(spark):
    """Documents of any size: SARIF in parts, a card for every finding, the seed."""
    rows = [finding(f"F-{i:04d}", S.SEVERITIES[i % 5], advocate_verdict="confirmed", engagement_id="e" if i % 3 else "other") for i in range(350)]
    f = spark.createDataFrame(rows, FINDING)
    parts = report.sarif_parts(f, rows=40).collect()
    for e in ("e", "other"):
        text = "".join(r.text for r in sorted((r for r in parts if r.engagement_id == e), key=lambda r: r.part))
        assert json.loads(text) == json.loads(report.sarif(f).where(F.col("engagement_id") == e).first().sarif)
    _documents_are_read_back_part_by_part(spark, f)
    md = report.markdown(f, spark.createDataFrame([], "engagement_id string, stage string"), "e")
    assert md.count("### F-") == sum(r[0] == "e" for r in rows) and md.index("## Critical") < md.index("## Info") and "No chains." in md
    cites = spark.createDataFrame([("e", "F-0001", "code"), ("other", "F-0002", "code")], "engagement_id string, finding_id string, citation_type string")
    chains = spark.createDataFrame([("e", "AC-2", "gate_evasion", "F-0001", None, None, "why"), ("other", "AC-1", "x", "y", None, None, "")], "engagement_id string, id string, stage string, finding_id string, evidence_id string, next_chain_id string, rationale string")
    triples = spark.createDataFrame([("e", "1", "a", "b", "c", 0.5)], "engagement_id string, id string, subject string, predicate string, object string, confidence double")
    seed, inside, filtered = report.seed_document(f, cites, chains, triples, "e", "hash", signer=lambda b: "s")
    mine = [r for r in rows if r[0] == "e"]
    assert inside == sum(r[2] not in ("low", "info") for r in mine) and inside + filtered == len(mine) and report.verified(seed)
    by = {x["id"]: x for x in seed["findings"]}
    assert by["F-0001"]["citations"] == ["code"] and by["F-0002"]["citations"] == [] and list(by) == sorted(by)
    assert [c["id"] for c in seed["attack_chains"]] == ["AC-2"] and seed["knowledge_triples"][0]["rationale"] is None and seed["signature"] == "s"


def test_ids_by_ranges_of_the_order(spark):
    rows = [("e" if i % 10 else "o", i * 37 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "engagement_id string, a int, b int")
    got = dedup.numbered(df, F.lit("TC"), ["a", F.col("b")], ["engagement_id"]).collect()
    for e in "eo":
        mine = sorted((r.a, r.b, r.id) for r in got if r.engagement_id == e)
        assert [x[2] for x in mine] == [f"TC-{i:04d}" for i in range(1, len(mine) + 1)]
    assert dedup.numbered(df.limit(0), F.lit("TC"), ["a"], ["engagement_id"]).collect() == []


def test_whole_findings_and_scalars(spark):
    f = spark.createDataFrame([finding("F-1"), finding("F-2", "odd", poc_status="maybe")], FINDING)
    got = {r.id: r for r in triage.whole(f).collect()}
    assert list(got["F-1"].asDict())[:-1] == [c.split()[0] for c in TABLES["findings"].split(", ")] and len(TABLES["findings"].split(", ")) == 22
    assert got["F-1"].decode_error is None and got["F-2"].decode_error == "severity,poc_status" and triage.detail(f, "e", "F-2").first().rank_score is None
    paths = spark.createDataFrame([("a/b.PY",), ("x.tsx",), ("Makefile",), (".py",), ("a.tar.gz",), ("m.cjs",), (None,)], "p string")
    assert [r[0] for r in paths.select(S.sandbox_language(F.col("p"))).collect()] == ["python", "typescript", None, None, None, "javascript", None]
    args = spark.createDataFrame([("a/b.py", True), ("../x", False), ("/etc", False), ("a/../b", False), ("a/..", False), ("a..b/c", True), ("a b", False), ("a\n", False), (None, False)], "v string, want boolean")
    assert all(r.got == r.want for r in args.select(S.valid_argument(F.col("v"), "file_path").alias("got"), "want").collect())
    one = spark.range(1).select(*(S.valid_argument(F.lit(v), k).alias(k) for k, v in {"cwe_id": "CWE-79", "severity_level": "info", "audit_language": "cobol"}.items())).first()
    assert tuple(one) == (True, True, False)
    times = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05.25+02:00",), ("2026-01-02",), ("junk",)], "t string")
    assert [r[0] for r in times.select(S.to_rfc3339(S.from_rfc3339(F.col("t")))).collect()] == ["2026-01-02T03:04:05+00:00", "2026-01-02T01:04:05.250000+00:00", None, None]


def test_rules_from_a_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"id": "no-secrets", "permit": False, "when": "kind = 'secret'"}]))
    (tmp_path / "a.json").write_text(json.dumps([{"id": "read", "permit": True, "principals": ["reader"], "actions": ["read"]}]))
    (tmp_path / "c.txt").write_text("not a rule")
    rules = policy.rules_from(str(tmp_path))
    assert [r.id for r in rules] == ["read", "no-secrets"]
    df = spark.createDataFrame([("reader", "read", "page"), ("reader", "read", "secret"), ("other", "read", "page")], "principal string, action string, kind string")
    assert [(r.allowed, r.reasons) for r in policy.authorise(df, rules).collect()] == [(True, ["read"]), (False, ["no-secrets"]), (False, [])]
    (tmp_path / "d.json").write_text(json.dumps([{"id": "read", "permit": True}]))
    with pytest.raises(ValueError):
        policy.rules_from(str(tmp_path))


def test_lenient_journals_drop_what_is_no_entry(spark, tmp_path):
    path = str(tmp_path / "j.jsonl")
    journal.append(path, [{"timestamp": "t", "principal": "p", "action": "a", "resource": "r", "cedar_decision": "permit"}])
    with open(path, "a") as f:
        f.write('{"foo":1}\nnot json\n')
    assert journal.read_lenient(spark, path).count() == 1 and journal.verify(spark, path).first().first_bad == 1


def test_suppression_counts(spark):
    files = spark.createDataFrame([("a", "import {html} from 'lit-element'"), ("b", "import x from 'lit'\nconst $ = require('jquery')"), ("c", "// import 'lit'")], "path string, text string")
    found = spark.createDataFrame([("semgrep", "x.jquery.y", p) for p in "abc"] + [("semgrep", "other", "a")], "tool string, rule_id string, file_path string")
    kept, gone = suppress_lit(found, files)
    assert sorted((r.rule_id, r.file_path) for r in kept.collect()) == [("other", "a"), ("x.jquery.y", "b"), ("x.jquery.y", "c")] and gone.first().suppressed == 1
