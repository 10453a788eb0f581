import random

from evidentia.operators import vector


def test_passes_find_what_one_pass_finds(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(80)], "id long, vector array<double>")
    queries = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    found = lambda most: sorted(tuple(r) for r in vector.nearest_each(rows, queries, 3, 3, most_bytes=most).select("query_id", "rank", "id", "distance").collect())
    one = found(1 << 20)
    assert found(100) == one and len(one) == 60
    data = {r.id: r.vector for r in rows.collect()}
    want = [(q, n, i, d) for q in range(0, 80, 4) for n, (d, i) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(data[q], v)), i) for i, v in data.items())[:3])]
    assert one == want
    assert vector.nearest_each(rows, queries.limit(0), 3, 3).count() == 0
