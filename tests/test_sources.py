import json

import pytest
from evidentia.operators import extract, graph
from evidentia.sources import files, manifests, threat_model
from evidentia.sources.store import Store
from evidentia.streaming import journal_stream
from pyspark.sql import functions as F

TREE = {
    "app/__init__.py": "from flask import Flask\n", "app/routes.py": "from flask import request\n\n@app.route('/u')\ndef users():\n    name = request.args['n']\n    q = name\n    cursor.execute(q)\n",
    "requirements.txt": "# c\nFlask==2.0\n-r other\nrequests>=1 # why\n", "pyproject.toml": '[project]\ndependencies = ["flask>=9", "rich[x]~=1"]\n[tool.poetry.dependencies]\npython = "3"\nclick = {version = "8"}\n',
    "Pipfile": '[packages]\nattrs = "*"\n', "poetry.lock": '[[package]]\nname = "click"\nversion = "8.1"\n[[package]]\nname = "six"\nversion = "1"\n', "Dockerfile": "FROM x", "k8s/a.yaml": "a: 1", "x.yml": "b",
    "node_modules/z.js": "x", "src/a.JS": "let x = 1", "blank.py": " \n", "composer.json": '{"laravel/framework": 1}',
}


@pytest.fixture
def tree(tmp_path):
    for name, body in TREE.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "repo" / "bad.py").write_bytes(b"\xff\xfe")
    return str(tmp_path / "repo")


def test_scan_overview_and_facts(spark, tree):
    found = files.scan(spark, tree)
    paths = {r.path for r in found.collect()}
    assert "app/routes.py" in paths and not any("node_modules" in p for p in paths)
    texts = files.texts(found)
    langs = {r.path: r.language for r in texts.collect()}
    assert langs["Dockerfile"] == "dockerfile" and langs["src/a.JS"] == "javascript" and "bad.py" not in langs and "blank.py" not in langs
    o = files.overview(found.select("path", F.col("content").cast("string").alias("text")))
    row = o.first()
    assert row.languages == ["dockerfile", "iac", "javascript", "json", "python", "toml", "yaml"] and row.frameworks == ["flask", "laravel"]
    assert row.package_managers == ["composer", "pip", "pipenv", "poetry"] and row.entrypoints == ["app/__init__.py"]
    assert ("framework", '{"name":"flask"}') in {(r.kind, r.json) for r in files.facts(o, "e").collect()}
    assert {r.file_path for r in files.in_scope(texts.withColumnRenamed("path", "file_path"), ["app/"], ["app/__"]).collect()} == {"app/routes.py"}
    assert files.resolve_within(tree, "app").endswith("app") and files.target_tree(None, "") == "." and files.git_facts(tree)["head"] is None
    with pytest.raises(ValueError):
        files.resolve_within(tree, "../x")


def test_dependencies(spark, tree):
    got = {r.name: (r.version_spec, r.resolved_version, r.source_file, r.kind) for r in manifests.dependencies(files.texts(files.scan(spark, tree))).collect()}
    assert got["Flask"] == ("==2.0", None, "requirements.txt", "direct") and got["flask"][0] == ">=9" and got["rich"] == ("~=1", None, "pyproject.toml", "direct")
    assert got["click"] == ("8", "8.1", "pyproject.toml", "direct") and got["six"] == ("", "1", "poetry.lock", "transitive") and got["attrs"][2] == "Pipfile" and "python" not in got


def test_source_to_chain(spark, tree):
    """From files to an unguarded chain, end to end."""
    model = threat_model.draft(["python"])
    found = extract.facts(files.texts(files.scan(spark, tree)))
    edges = extract.edges(found, "e")
    lines = graph.file_lines(files.texts(files.scan(spark, tree)))
    chains = graph.taint_chains(edges, model["sources"], model["sinks"], model["guards"], extract.symbols(found, "e"), lines, "e").collect()
    assert [(c.source_file, c.source_line, c.sink_line, c.sanitizers_seen) for c in chains] == [("app/routes.py", 5, 7, ["unguarded"])]
    assert [(r.method, r.path, r.handler_symbol) for r in extract.routes(found, "e").collect()] == [("GET", "/u", "users")]


def test_threat_model(spark):
    own = threat_model.draft(["go", "javascript", "go"], {"sinks": ["only.this"], "exclude_paths": ["x"]})
    assert own["sinks"] == ["only.this"] and "r.FormValue" in own["sources"] and "req.query" in own["sources"] and own["languages"] == ["go", "javascript"]
    assert threat_model.draft(["java"])["sources"] == [] and threat_model.defaults(spark).where("language = 'javascript' and role = 'source'").count() == 7


def test_tool_manifests_and_scope(spark, tmp_path):
    (tmp_path / "b.tool.toml").write_text('[tool]\nname = "b_tool"\nversion = "1"\ndescription = "d"\n[tool.cedar]\nresource = "R"\naction = "execute_tool"\n[args.x]\ntype = "string"\n')
    (tmp_path / "a.tool.toml").write_text('[tool]\nname = "a"\nversion = "1"\ndescription = "d"\n')
    assert [(r.name, r.resource, r.args) for r in manifests.tool_manifests(spark, str(tmp_path), ".tool.toml").collect()] == [("a", None, []), ("b_tool", "R", ["x"])]
    (tmp_path / "c.tool.toml").write_text('[tool]\nname = "Bad Name"\nversion = "1"\ndescription = "d"\n')
    with pytest.raises(ValueError):
        manifests.tool_manifests(spark, str(tmp_path), ".tool.toml")
    (tmp_path / "scope.toml").write_text('sources = ["s"]\n')
    assert manifests.scope_overrides(str(tmp_path / "scope.toml"))["sources"] == ["s"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db")).open()
    edge = "engagement_id string, from_symbol string, to_symbol string, edge_kind string, file_path string, line int"
    rows = spark.createDataFrame([("e1", "a", "b", "assign", "f", 1), ("e1", "a", "b", "return", "f", 1), ("e2", "a", "b", "assign", "f", 1)], edge)
    store.insert_or_ignore("dataflow_edges", rows, ["edge_kind"])
    store.insert_or_ignore("dataflow_edges", rows.where("line = 1"))
    got = store.read("dataflow_edges").collect()
    assert sorted((r.engagement_id, r.edge_kind) for r in got) == [("e1", "assign"), ("e2", "assign")]
    plan = store.read("dataflow_edges", "e1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(engagement_id" in plan
    store.overwrite_engagement("dataflow_edges", "e1", store.read("dataflow_edges", "e1").withColumn("line", F.lit(9)))
    assert sorted((r.engagement_id, r.line) for r in store.read("dataflow_edges").collect()) == [("e1", 9), ("e2", 1)]
    assert store.read("findings").count() == 0


def test_streams(spark, tmp_path):
    from evidentia.operators import journal

    (tmp_path / "in").mkdir()
    journal.append(str(tmp_path / "in" / "a.jsonl"), [{"timestamp": str(i)} for i in range(3)])
    q = journal_stream.linked(journal_stream.entries(spark, str(tmp_path / "in"), 1), "timestamp").writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        last = json.loads((tmp_path / "in" / "a.jsonl").read_text().splitlines()[-1])["entry_hash"]
        more = [journal.entry_line({"timestamp": "3"}, last), journal.entry_line({"timestamp": "4"}, "0" * 64)]
        (tmp_path / "tmp").write_text("\n".join(more) + "\n")
        (tmp_path / "tmp").rename(tmp_path / "in" / "a.2.jsonl")
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.link_ok for r in spark.sql("select * from linked order by ordinal").collect()] == [True, True, True, True, False]
    schema = "ts timestamp, tool string, k string"
    spark.createDataFrame([("2024-01-01 00:01:00", "a", "1"), ("2024-01-01 00:02:00", "a", "1"), ("2024-01-01 00:07:00", "b", "2")], "ts string, tool string, k string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))
    for name, df, n, mode in (("dedup", journal_stream.deduplicated(read(), "ts", ["k"]), 2, "append"), ("counts", journal_stream.counts_by_tool(read(), "ts", "tool"), 2, "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_listing_prunes_before_it_enters(spark, tmp_path):
    import os

    for name in ("a.py", "_b/.c/d.rs", "node_modules/deep/e.js", "f/target/g.rs", "f/h"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * len(name))
    os.symlink(tmp_path, tmp_path / "f" / "loop")
    (tmp_path / "node_modules" / "deep").chmod(0)
    try:
        got = sorted((r.path, r.length) for r in files.listed(spark, f"file://{tmp_path}").collect())
    finally:
        (tmp_path / "node_modules" / "deep").chmod(0o755)
    assert got == [("_b/.c/d.rs", 10), ("a.py", 4), ("f/h", 3)]
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).collect() == []
