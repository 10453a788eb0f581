import random

from pyspark.sql import functions as F

from evidentia.operators.paging import SortedRun

COLS = "k string, n int, _tie string"


def keyed(r):
    return (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)


def test_pages_united_are_the_table_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), "x") for _ in range(60)]  # mostly ties, repeated rows
    run = SortedRun(spark.createDataFrame(rows, COLS), ["k", "n"], 11)
    pages = list(run.drain(17))
    assert [len(p) for p in pages] == [17, 17, 17, 9]
    got = [tuple(r)[:3] for p in pages for r in p]
    assert got == sorted(rows, key=keyed)
    assert len({r[run.tie] for p in pages for r in p}) == 60
    # a prefix of the order leaves out all that begin so
    assert [r.k for r in run.after(("a",), 100).collect()] == ["b"] * sum(r[0] == "b" for r in rows)
    assert run.after(("b", 2), 5).count() == 0 and run.after((None, None), 100).count() == sum(r[:2] != (None, None) for r in rows)


def test_a_deep_page_reads_one_or_two_files(spark):
    run = SortedRun(spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("id")), ["id"], 500)
    page = run.after((7777,), 100)
    assert [r.id for r in page.collect()] == list(range(7778, 7878))
    plan = page._jdf.queryExecution().executedPlan().toString()
    told = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert run.bounds.count() == 20 and told.count(",") <= 2


def test_empty(spark):
    run = SortedRun(spark.createDataFrame([], COLS), ["k"])
    assert list(run.drain()) == [] and run.after(("a",)).count() == 0
