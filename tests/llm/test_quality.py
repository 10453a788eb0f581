import zlib

import numpy as np
from evidentia.llm import quality as q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_linear_time_equals_pair_sum():
    r = np.random.default_rng(1)
    m = q.Machine(0.3, r.normal(size=q.FEATURES), r.normal(size=(q.FEATURES, q.RANK)))
    at, x = q.features("One two three two. Four!\nfive FIVE 12 %%")
    want = 0.3 + sum(m.weights[a] * v for a, v in zip(at, x))
    for i in range(len(at)):
        for j in range(i):
            want += m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j]
    assert abs(m.logit(at, x) - want) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert right > 0.85 and auc > 0.9, (right, auc)
    for r in got:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "word " * 100_000, "d"), (None, "some text here", "e"), (1, None, "a"), (5, "some text here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (4, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[5] == by[None]
    assert q.classify(docs.limit(0), labels.limit(0)).collect() == []
    alone = q.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    kept = q.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 7
    clash = docs.withColumnRenamed("score", "_score").selectExpr("*", "'d' AS doc")
    assert sorted(str((r._score, r.doc)) for r in q.keep_good(clash, labels).collect()) == sorted(str((r._score, "d")) for r in clash.collect() if (by.get(r.doc_id) or 1) >= 0.3)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = q.train(docs, labels), q.train(docs, turned)
    assert a.bias == b.bias and (a.factors == b.factors).all()


def seen_by_learn(monkeypatch):
    seen = []
    learn = q.learn
    monkeypatch.setattr(q, "learn", lambda rows, labels, **o: seen.append(rows) or learn(rows, labels, **o))
    return seen


def test_learning_reads_one_row_an_id(spark, monkeypatch):
    """The bound on rows holds for ids that repeat, whose row does not depend on the run."""
    seen = seen_by_learn(monkeypatch)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"text {i} of one id") for i in range(20_000)] + [(i, f"some words {i}") for i in ids[1:]] + [(ids[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    a, b = q.train(docs, labels, most_rows=10), q.train(docs.repartition(7, "text"), labels, most_rows=10)
    assert [len(s) for s in seen] == [10, 10] and a.bias == b.bias and (a.factors == b.factors).all()
    q.train(docs, labels)
    assert len(seen[-1]) == len(ids)


def test_learning_reads_a_bounded_number_of_features(spark, monkeypatch):
    seen = seen_by_learn(monkeypatch)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(1000))) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    q.train(docs, labels, most_features=5000)
    assert 3 <= len(seen[0]) < len(ids) and sum(len(at) for at, _ in seen[0]) <= 5000
