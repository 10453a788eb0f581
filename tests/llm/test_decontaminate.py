import random
import re

from evidentia.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item_id, t in items:
        iw = words(t)
        k = min(len(iw), 13)
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit |= {*range(i, i + k)}
                ids.add(item_id)
    return len(w), len(hit), sorted(str(i) for i in ids if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)


def tables(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcé1") for _ in range(r.randint(1, 3))) for _ in range(40)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([1, 5, 12, 13, 14, 30]))) for i in range(2, 14)] + [(20, None), (21, ""), (22, "!?"), (None, say(20))]
    items += [items[3], (30, items[4][1])]
    docs = []
    for i in range(60):
        t = say(r.choice([0, 3, 30, 300]))
        if r.random() < 0.6:
            x = (r.choice(items)[1] or "").split(" ")
            a = r.randint(0, max(0, len(x) - 13))
            t = say(r.choice([0, 5, 200])) + ", " + "\n--".join(x[a : a + r.randint(10, 20)]).upper() + "! " + t
        docs.append((i, t))
    return docs + [(90, None), (91, ""), (92, ".."), (None, items[3][1]), (5, docs[5][1]), (93, say(100_000))], items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, found string, items long"),
        spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string"),
    )


def test_matches_brute_force(spark):
    docs, items = tables()
    got = d.scan(*frames(spark, docs, items)).collect()
    have = sorted([(str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got])
    assert have == sorted((str(i), *brute(t, items)) for i, t in docs)
    texts = dict(docs)
    for r in got:
        for s in r.spans:
            part = texts[r.doc_id].encode()[s.start : s.end].decode()
            assert words(part) and part[0] not in " ,." and part[-1] not in " ,."


def test_passes_agree(spark):
    """A benchmark of many blocks gives what one automaton gives."""
    docs, items = tables(4)
    a, b = frames(spark, docs, items)
    assert len(list(d.scanners(b))) == 1 and len(list(d.scanners(b, most_windows=20))) > 3
    key = lambda r: str((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans, r.hits, r.contaminated))
    one, many = (sorted(map(key, d.scan(a, b, most_windows=n).collect())) for n in (200_000, 40))
    assert one == many
    kept = [sorted(str(r) for r in d.keep_clean(a, b, most_windows=n).collect()) for n in (200_000, 40)]
    assert kept[0] == kept[1]


def test_spans_do_not_depend_on_passes(spark):
    """Items that touch end to start, overlap or repeat give one span however many automata scan."""
    say = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    items = [(1, say(0, 13)), (2, say(13, 26)), (3, say(30, 43)), (4, say(36, 49)), (5, say(60, 61))]
    text = say(0, 26) + " -- " + say(26, 30) + "! " + say(30, 80) + ", w60 w60"
    docs = [(1, text), (2, "\u00fc " * 50 + text), (3, None), (4, (say(0, 26) + " x ") * 300)]
    a, b = frames(spark, docs, items)
    got = [{r.doc_id: (r.n_words, r.n_hit, r["items"], r.spans, r.hits) for r in d.scan(a, b, most_windows=n).collect()} for n in (200_000, 30, 3)]
    assert len(list(d.scanners(b, most_windows=3))) > 5 and got[0] == got[1] == got[2]
    assert [tuple(h) for h in got[0][1][4]] == [(0, 26), (30, 49), (60, 61), (80, 82)]
    assert text.encode()[slice(*got[0][1][3][0])].decode() == say(0, 26) and len(got[0][4][4]) == 300


def test_clashing_names(spark):
    docs, items = tables(6)
    names = ["_found", "doc", "found", "row_id", "_row"]
    a = spark.createDataFrame([(i, t, *names) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for n in (200_000, 40):
        got = d.keep_clean(a, frames(spark, docs, items)[1], most_windows=n)
        assert got.columns == a.columns and all([r[x] for x in names] == names for r in got.collect())


def test_keep_clean_and_empty_tables(spark):
    docs, items = tables(5)
    a, b = frames(spark, docs, items)
    kept = d.keep_clean(a, b)
    assert kept.columns == a.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if not brute(t, items)[3])
    assert d.scan(a.limit(0), b).collect() == []
    assert not any(r.n_hit for r in d.scan(a, b.limit(0)).collect())
