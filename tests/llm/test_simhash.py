import random

import xxhash
from evidentia.llm import simhash
from evidentia.llm.common import Scratch

SCHEMA = "doc_id long, text string, fp string, n_chars long"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = (r.choice(rows)[1] or "").split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 40, 400])))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "A B c"), (n + 4, "a b C"), (3, "one one"), (3, "one one")]
    rows += [(None, "lonely words stand here without id"), (n + 9, "x " * 200_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", None) for d, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted(brute_components(rows), key=key)


def test_long_lists_lose_no_link(spark):
    """Clouds of fingerprints around a few centres, resolved with lists of at most 2 and at most 1,000."""
    r = random.Random(5)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = []
    for longest in (2, 1000):
        scratch = Scratch(spark, "t")
        found = simhash.links(df, scratch, longest)
        for row in found.collect():
            assert bin((row.u ^ row.v) & (1 << 64) - 1).count("1") <= 3
        roots.append(sorted(map(tuple, simhash.smallest_reachable(found, scratch).collect())))
    assert roots[0] == roots[1] and roots[0]


def test_empty_and_keep_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    rows = [(i, t) for i, (_, t) in enumerate(corpus(2, 30))]
    kept = simhash.keep_rows(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "n_chars"]
    want = sorted({c for _, _, c in brute_components(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_rows(frame(spark, [])).collect() == []


def test_repeated_ids_and_clashing_names(spark):
    rows = corpus(3, 20)
    names = ["_fp", "row", "doc", "_key", "least", "fp"]
    docs = spark.createDataFrame([(d, t, *names) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.keep_rows(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all([r[n] for n in names] == names for r in got)
    parts = {}
    for (d, t), p in zip(rows, map(brute_print, (t for _, t in rows))):
        parts.setdefault(p, []).append((d is None, d or 0, t or ""))
    groups = []
    for p, members in parts.items():
        near = [g for g in groups if any((p ^ q).bit_count() <= 3 for q in g[0])]
        groups = [g for g in groups if g not in near] + [({p}.union(*(g[0] for g in near)), sum((g[1] for g in near), members))]
    ids = lambda ms: sorted(ms)[0][:2]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(ids(m) for _, m in groups)
    assert len(got) == len(groups)


def test_hot_keys_without_adaptive_plans(spark):
    """A third of all rows has one key; no task of the second join gets it."""
    from evidentia.llm.common import join_by_count
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
        keyed = rows.where("id % 5 > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        got = sorted(map(tuple, join_by_count(rows, keyed, ["k"]).collect()))
        assert got == sorted(map(tuple, rows.join(keyed.drop("n"), "k").select("k", "id", "least").collect()))
        whole = join_by_count(rows, keyed, ["k"], how="left").collect()
        assert len(whole) == 9000 and sum(r.least is not None for r in whole) == len(got)
        copies = corpus(6, 20) + [(1000 + i, "one text that many rows have, word by word") for i in range(400)]
        out = simhash.near_duplicates(frame(spark, copies)).collect()
        assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in out))) == sorted(map(str, brute_components(copies)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_without_id_or_with_the_same_id_stay(spark):
    import corpus_pipeline

    r = random.Random(9)
    say = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, a), (9, e), (5, e)]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "fp", "n_chars"]
    got = sorted((str(x.doc_id), x.text) for x in kept.collect())
    assert got == sorted([("None", b), ("7", c), ("7", d), ("8", a), ("5", e)])
