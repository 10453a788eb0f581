import hashlib
import random

import zstandard
from evidentia.llm import substrings as s


def brute(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, (d is not None, d or 0)), (d is not None, d or 0))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < (d is not None, d or 0):
                gone |= {*range(i, i + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=80, vocab=30):
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 4))) for _ in range(vocab)]
    say = lambda k: [r.choice(words) for _ in range(k)]
    passages = [say(r.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            p = list(r.choice(passages)) if r.random() < 0.6 else say(r.randint(0, 20))
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = r.choice(words)
            w += p[r.randint(0, 4) :]
        if rows and r.random() < 0.2:
            w = (r.choice(rows)[1] or "").split()
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows + [(500, None), (501, ""), (502, " \n"), (None, " ".join(passages[0] + passages[1])), (3, rows[0][1]), (3, rows[0][1]), (503, "again " * 5000), (504, "again " * 4000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, first int, packed string")


def test_matches_brute_force(spark):
    for seed, length, gram in ((1, 10, 4), (2, 7, 3)):
        rows = corpus(seed)
        got = s.dedup(frame(spark, rows), length, gram).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, length)
        for r in got:
            assert sum(x.end - x.first for x in r.repeats) == r.n_removed
            assert r.packed is None or hashlib.sha256(zstandard.decompress(bytes(r.packed))).hexdigest() == r.kept_sha256


def test_anchors_cover_all_windows():
    r = random.Random(3)
    for n in (49, 50, 51, 89, 500):
        words = [str(r.randrange(20)).encode() for _ in range(n)]
        gram, _, first, last = s.anchors(words)
        assert sum(last - first + 1) == max(0, n - 49)
        if len(first):
            assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == n - 50
    same = s.anchors([b"x"] * 200)
    assert [x.tolist() for x in same[2:]] == [[0], [150]]
    pairs = s.anchors([b"x", b"y"] * 100)
    assert len(pairs[0]) == 1


def test_drop_repeats_and_empty(spark):
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, say(0, 100)), (2, "lead  in " + say(10, 80) + " out"), (3, say(0, 100)), (4, None), (5, "two  spaces"), (None, say(900, 999))]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in s.drop_repeats(docs).collect()}
    assert set(got) == {1, 2, 4, 5, None} and got[2].text == "lead in out" and got[2].n_chars == 11
    assert got[1].text == rows[0][1] and got[5].text == "two  spaces" and got[5].n_chars == 7 and got[4].text is None
    assert s.dedup(docs.limit(0)).collect() == []


def test_drop_repeats_of_rows_with_the_same_id(spark):
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, say(0, 100)), (2, "a " + say(10, 80) + " z"), (2, "b  " + say(0, 60) + " y"), (2, say(0, 100)), (2, "not  cut"), (2, "b " + say(0, 60) + " y")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in s.drop_repeats(docs).collect())
    assert got == sorted([(1, rows[0][1], 7), (2, "a z", 3), (2, "b y", 3), (2, "b y", 3), (2, "not  cut", 7)])


def test_drop_repeats_with_clashing_names(spark):
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    names = ["_id", "_packed", "_gone", "id", "cut", "packed", "gone", "words", "doc", "kept"]
    rows = [(1, say(0, 100)), (2, "a " + say(10, 80)), (2, None), (None, ""), (3, say(0, 100))]
    docs = spark.createDataFrame([(d, t, 7, *names) for d, t in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    out = s.drop_repeats(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = out.collect()
    assert all([r[n] for n in names] == names for r in got)
    assert sorted(((str(r.doc_id), r.text or "", r.n_chars) for r in got)) == sorted([("1", rows[0][1], 7), ("2", "a", 1), ("2", "", 7), ("None", "", 7)])
    assert s.drop_repeats(docs.limit(0)).collect() == []
