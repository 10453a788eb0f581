import re

from evidentia.llm import licenses

SCHEMA = "doc_id long, text string, label string, start long, template int, bits string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, None) for d, t in rows], SCHEMA)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w, places = words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


TEXTS = [
    None, "", " \n", "CC-BY cc by CC BY", "cc", "by cc", "All Rights Reserved. all rights, reserved all rights",
    "the GNU General Public License general public\nlicense", "İcc by", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.", "licensed under an Apache license version 2.0 of it",
    "Licensed under Apache License, Version 2.0", "of the " * 5000 + "all rights reserved", "all rights reserved " * 3000,
    "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and the associated documentation files",
    "licence licensed the under license apache", "ünder rights reserved all rights reservedü",
]


def test_base_matches_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "cc by"), (3, TEXTS[3]), (3, TEXTS[3])]
    got = licenses.scan(frame(spark, rows)).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(
        [(d, *brute_base(t)) for d, t in rows], key=key
    )
    for r in got:
        assert 0 <= r.score <= 1 and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}


def test_notices_with_small_differences(spark):
    got = {r.doc_id: r for r in licenses.scan(frame(spark, enumerate(TEXTS))).collect()}
    labels = {i: got[i].labels for i in got}
    assert labels[9] == "cc-by,cc-by-nc" and labels[10] == "apache-2.0" and labels[11] == "apache-2.0"
    assert labels[12] == "apache-2.0" and labels[15] == "mit" and labels[16] == "" and got[10].score == 1.0
    assert labels[13] == "reserved" and got[0].score == 0.0


def test_whole_licences(spark):
    """Whole texts of any length, with a name put in, words left out, and the half of one."""
    whole = {label: words for label, words in licenses.NOTICES if label.endswith("-text")}
    assert max(len(w.split()) for w in whole.values()) > 200
    mit, bsd = whole["mit-text"].split(), whole["bsd-3-text"].split()
    texts = {
        1: " ".join(["Copyright (c) 2020 Some One.", *mit]), 2: " ".join(mit[:60] + ["of", "course"] + mit[60:100] + mit[102:]), 3: " ".join(mit[: len(mit) // 3]),
        4: " ".join(bsd).upper(), 5: whole["isc-text"], 6: "the software or the use of this software " * 3000, 7: whole["bsd-2-text"],
    }
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts.items())).collect()}
    assert {"mit-text", "mit", "as-is"} <= {*got[1].labels.split(",")} and "mit-text" in got[2].labels and "mit-text" not in got[3].labels
    assert "bsd-3-text" in got[4].labels and got[4].score == 1.0 and "isc-text" in got[5].labels and got[6].labels == ""
    assert "bsd-2-text" in got[7].labels


def test_empty(spark):
    assert licenses.scan(frame(spark, [])).collect() == []


def test_native_plan(spark):
    plan = licenses.scan(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


CROWDED = {
    1: "released under the mit license" + " mit license" * 6, 2: "mit license " * 6 + "released under the mit license", 3: "the mit license " * 40,
    4: "mit license " * 5 + "released today under the mit license" + " mit license" * 5, 5: "license under the " * 30 + "released under the mit license",
    6: "licensed under " * 20 + "licensed under the apache license version 2 0 " + "apache license version " * 20, 7: "released under the mit license " * 5,
    8: "released released under under the the mit mit license license", 9: "under the mit license",
}


def test_copies_next_to_repeated_phrases(spark):
    """A copy is found beside repeats that chain to it, before, after and around it."""
    got = {r.doc_id: r for r in licenses.scan(frame(spark, CROWDED.items())).collect()}
    assert {i: got[i].labels for i in (1, 2, 4, 5, 7)} == dict.fromkeys((1, 2, 4, 5, 7), "mit") and got[6].labels == "apache-2.0"
    assert got[1].score == got[2].score == got[5].score == got[6].score == 1.0 and got[3].labels == ""
    found = licenses.spans(frame(spark, CROWDED.items())).where("doc_id = 1 AND label IS NOT NULL").collect()
    assert [(r.label, r.start, r.end) for r in found] == [("mit", 0, 5)]


def test_sql_says_the_same(spark):
    import duckdb

    rows = [*CROWDED.items(), *((100 + i, t) for i, t in enumerate(TEXTS))]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = c.execute("SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, round(score, 9) FROM (" + licenses.oracle_sql() + ")").fetchall()
    got = licenses.scan(frame(spark, rows)).selectExpr("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "round(score, 9)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_copy_with_words_put_in_beside_repeats(spark):
    """The group around the strongest diagonal counts where it says more than that diagonal alone."""
    notice = "licensed under the apache license really version 2 0"
    for before in ("", "x y z ", "under the apache license " * 15):
        text = before + notice + " apache license version" * 15
        (one,) = licenses.spans(frame(spark, [(1, text)])).where("label IS NOT NULL").collect()
        at = len(before.split())
        assert one.label == "apache-2.0" and one.start <= at and one.end >= at + 9 and one.coverage == 6 / 7
