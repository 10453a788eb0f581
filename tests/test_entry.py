import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import norm

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
AUDIT = [k for k in entry.queries() if not k.startswith(("op", "pipeline")) or k == "osv_join"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", AUDIT)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        rel = con.execute(entry.oracle_sql()[name])
        columns = [x[0] for x in rel.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted((tuple(norm(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in rel.fetchall()), key=repr)
        assert got == want


def test_the_rest_stands_without_the_training_data_part(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith('op1_') or k == 'pipeline']; assert 'osv_join' in e.queries(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(at)})
    assert done.returncode == 0, done.stderr
