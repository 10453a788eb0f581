import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from evidentia.llm import packing
from evidentia.llm.common import Scratch
from evidentia.llm.wordpiece import public_path, word_bpe
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "It's they'll we'd 'S", "naïve ÉCOLE straße İstanbul ǅ", "x² ½ 3.14 １２", "<|endoftext|> <|x|>", "日本語 text", "é é", "a\x1cb\x85c\xa0d",
       "snake_case __init__", "ΣΑΣ Σ", "don't-stop...now!!", "’s “q” — x", "ªº ªx", "€5 £3", "a,b,c.", "word. word, word! .word"]


def test_ids_equal_the_tokenizer():
    t, bpe = Tokenizer.from_file(public_path()), word_bpe(public_path())
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()] + ODD
    for text in texts:
        assert np.frombuffer(bpe.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF), max_size=40))
def test_ids_equal_the_tokenizer_on_any_text(text):
    t, bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), word_bpe(public_path())
    assert np.frombuffer(bpe.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def laid_out(counts, capacity, ranges=3):
    """Rooms by the sweeps of packing.plan, without Spark; and the rounds."""
    runs = [("piece", k, 0, n, 0, 0) for k, n in counts.items() if n]
    left = sum(counts.values())
    volume = sum(k * n for k, n in counts.items())
    opened, rounds, rooms = 0, 0, defaultdict(list)
    more = sum(n for k, n in counts.items() if 2 * k > capacity) or -(-volume // capacity)
    while left:
        if more:
            runs.append(("gap", capacity, opened, more, 0, 0))
            opened += more
        by = defaultdict(list)
        for r in runs:
            by[r[1] * ranges // (capacity + 1)].append(r)
        done = packing.settle(sum((packing.sweep(x, capacity) for x in by.values()), []), capacity)
        for _, length, rank, n, sequence, offset in (r for r in done if r[0] == "placed"):
            for i in range(n):
                rooms[sequence + i].append((offset, length, rank + i))
        rest = [r for r in done if r[0] == "piece"]
        left, volume = sum(r[3] for r in rest), sum(r[1] * r[3] for r in rest)
        more = max(1, volume // capacity)
        runs = [r for r in done if r[0] != "placed"]
        rounds += 1
    return rooms, rounds


def one_by_one(counts, capacity):
    """Sequences that best-fit needs, longest pieces first."""
    left = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in left if r >= length), default=None)
            if fit is None:
                left.append(capacity - length)
            else:
                left.remove(fit)
                left.append(fit - length)
    return len(left)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_is_gapless_and_near_the_bound(counts):
    rooms, _ = laid_out(counts, 32)
    total = sum(k * n for k, n in counts.items())
    ranks = sorted((length, rank) for x in rooms.values() for _, length, rank in x)
    assert ranks == sorted((k, i) for k, n in counts.items() for i in range(n))
    for x in rooms.values():
        at = 0
        for o, length, _ in sorted(x):
            assert o == at
            at += length
        assert at <= 32
    assert -(-total // 32) <= len(rooms) <= one_by_one(counts, 32) * 1.1 + 1


def test_plan_fills_sequences():
    r = random.Random(2)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, int(r.expovariate(1 / 500)) + 1)] += 1
    total = sum(k * n for k, n in counts.items())
    rooms, rounds = laid_out(dict(counts), 2048)
    assert len(rooms) <= -(-total // 2048) * 1.002 + 1 and rounds < 40


def test_plan_is_that_of_the_sweeps(spark):
    """The Spark rounds place every rank once, as the sweeps do without Spark."""
    r = random.Random(7)
    counts = defaultdict(int)
    for _ in range(3000):
        counts[min(64, int(r.expovariate(1 / 15)) + 1)] += 1
    counts[64] += 9000  # a third of all and more have one length
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    placed = packing.plan(table, Scratch(spark, "t"), 64)
    ranked = spark.createDataFrame([(k, i) for k, n in counts.items() for i in range(n)], "length long, rank long")
    got = defaultdict(list)
    for x in packing.placed_by_rank(ranked, placed, 100).collect():
        got[x.sequence_id].append((x.offset, x.length, x["rank"]))
    want, _ = laid_out(dict(counts), 64, 4)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_pack_round_trip(spark):
    t = Tokenizer.from_file(public_path())
    rows = [(i, x) for i, x in enumerate(ODD)] + [(50, "long words here " * 9000), (51, None), (51, None), (None, "no id"), (52, "same text"), (53, "same text")]
    docs = spark.createDataFrame([(i, x, 1, "y") for i, x in rows], "doc_id long, text string, length int, piece string")
    got = packing.pack(docs).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((str(i), p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for x in rooms.values():
        assert sorted(o for o, _ in x) == np.cumsum([0, *(n for _, n in sorted(x))])[:-1].tolist() and sum(n for _, n in x) <= 2048
    total = sum(r.length for r in got)
    assert len(rooms) == -(-total // 2048)
    assert packing.pack(docs.limit(0)).collect() == []
