import hashlib
import re

import pytest
from evidentia.llm import infill
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, n string, form int, output string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
UNITS = {"token": TOKEN.findall, "character": list, "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)


def brute(doc_id, text, unit="token", rate=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS[unit](text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t \r", "a", " a", "a ", "  a  b\tc\n\nd  ", "é ü x y 😀😀 日本語 z", "a <P> b", "<S>", "x<M>", "< P > <S", "<P", ">",
    "word " * 30000, "x" * 200000, " " * 100000, "\x1f\x1c a\x0b\x0cb\x85c", "\n\n\n", "a\n\nb\n",
]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n\té😀\x0b日", max_size=60), st.integers(0, 80), st.sampled_from(sorted(UNITS)))
def test_every_cut_is_where_the_units_end(text, cut, unit):
    data, units = text.encode(), UNITS[unit](text)
    runs = infill.runs_of(data, unit)
    assert runs.n == len(units)
    cut = min(cut, len(units))
    assert data[: runs.offset(cut)].decode() == "".join(units[:cut])


def test_runs_are_maximal():
    runs = infill.runs_of(b"ab  cd \n e")
    assert runs.ends.tolist() == [2, 4, 6, 9, 10] and runs.units.tolist() == [1, 1, 2, 2, 3]
    assert len(infill.runs_of("aa日日é".encode(), "character").ends) == 3


@pytest.mark.parametrize("unit, rate", [("token", 50), ("token", 100), ("character", 100), ("line", 100)])
def test_matches_brute_force(spark, unit, rate):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no id here"), (7, TEXTS[7]), (7, TEXTS[7]), (-3, "minus three words")]
    got = infill.transformed(frame(spark, rows), unit, rate)
    want = [brute(d, t, unit, rate) for d, t in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = got.select("doc_id", infill.restored(got.output, got.form).alias("text")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)


def test_empty_and_unknown_unit(spark):
    assert infill.transformed(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        infill.transformed(frame(spark, []), unit="word")
