import random

from pyspark.sql import functions as F

from evidentia.sources.store import Store

COLS = "engagement_id string, id string, title string"


def state(store):
    return sorted((r.engagement_id or "", r.id or "", r.title) for r in store.read("findings").collect())


def test_insertions_ignore_what_is_there(spark, tmp_path):
    rng, store, want = random.Random(3), Store(spark, str(tmp_path / "s"), buckets=8), {}
    for batch in range(2):
        rows = [(rng.choice(["a", "b c/ü%[x]*", None]), rng.choice([*map(str, range(12)), None, "null"]), f"t{batch}-{i:02}") for i in range(40)]
        store.insert_or_ignore("findings", spark.createDataFrame(rows, COLS), ["title"])
        for e, i, t in sorted(rows, key=lambda r: r[2]):
            want.setdefault((e, i), t)
    assert state(store) == sorted((e or "", i or "", t) for (e, i), t in want.items())
    # rows that came by another way are known, and what an overwrite took away is not
    store.append("findings", spark.createDataFrame([("z", "1", "appended"), ("z", "2", "appended")], COLS))
    again = spark.createDataFrame([("z", "1", "again"), ("z", "3", "again")], COLS)
    store.insert_or_ignore("findings", again)
    assert [s for s in state(store) if s[0] == "z"] == [("z", "1", "appended"), ("z", "2", "appended"), ("z", "3", "again")]
    store.overwrite_engagement("findings", "z", store.read("findings", "z").where("id = '2'"))
    store.insert_or_ignore("findings", again)
    assert [s for s in state(store) if s[0] == "z"] == [("z", "1", "again"), ("z", "2", "appended"), ("z", "3", "again")]
    store.insert_or_ignore("findings", spark.createDataFrame([], COLS))
    assert len(state(store)) == len(want) + 3


def test_one_row_reads_one_bucket_and_the_new_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.insert_or_ignore("findings", spark.range(5000).select(F.lit("a").alias("engagement_id"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title")))
    index = store.keys("findings")
    assert index.catch_up(store.read("findings")) > 0  # the files of the first insertion
    store.insert_or_ignore("findings", spark.createDataFrame([("a", "5000", "t")], COLS))
    assert index.catch_up(store.read("findings")) == 1 and index.catch_up(store.read("findings")) == 0
    one = index.known([3])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: []" in plan  # whole folders, not rows, are left out
    assert [r.bucket for r in one.select("bucket").distinct().collect()] == [3] and one.count() < 1000
    assert index.known(list(range(8))).count() == 5001
