import json

import pytest

from evidentia.operators import journal


def chain(n, pad=""):
    last, out = journal.GENESIS, []
    for i in range(n):
        line = journal.entry_line({"timestamp": str(i), "principal": "p" + pad, "action": "a", "resource": "r", "cedar_decision": "permit"}, last)
        last = json.loads(line)["entry_hash"]
        out.append(line)
    return out


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_several_ranges_keep_their_numbers(spark, tmp_path, small_ranges):
    folder = tmp_path / "j"
    folder.mkdir()
    want = {}
    for name, n in (("a", 150), ("b", 3), ("c", 0), ("d", 90)):
        lines = chain(n, "é" * 20)
        for at in range(10, len(lines), 37):
            lines.insert(at, "")
        (folder / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines), encoding="utf-8")
        want |= {(name, i): x for i, x in enumerate(lines)}
    rows = journal.read_lines(spark, str(folder)).collect()
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8  # several ranges a file
    assert {(r.journal.rsplit("/", 1)[1][0], r.ordinal): r.line for r in rows} == want and len(rows) == len(want)


def broken(lines, at):
    """The line, its parsed bad, and what a reader from the start would say."""
    out = list(lines)
    out[at] = out[at].replace('"action":"a"', '"action":"b"')
    return out


@pytest.mark.parametrize("piece", [1, 7, 100_000])
def test_verdicts_do_not_depend_on_pieces(spark, tmp_path, small_ranges, piece):
    folder = tmp_path / "j"
    folder.mkdir()
    good = chain(60)
    cases = {
        "sound": (good, None, 60), "body": (broken(good, 13), 13, 13), "border": (broken(good, 14), 14, 14), "first": (broken(good, 0), 0, 0),
        "gone": (good[:21] + good[22:], 21, 21), "swapped": ([*good[:27], good[28], good[27], *good[29:]], 27, 27), "late": (good[1:], 0, 0),
        "twice": (broken(broken(good, 50), 9), 9, 9), "noise": ([*good[:30], "no entry", *good[30:]], 30, 30), "blank": (good[:7] + [""] * 20 + good[7:], None, 60),
        "after": ([*good[:7], *[""] * 20, *broken(good, 7)[7:]], 27, 7),
    }
    for name, (lines, _, _) in cases.items():
        (folder / f"{name}.jsonl").write_text("\n".join(lines))
    got = {r.journal.rsplit("/", 1)[1].split(".")[0]: (r.first_bad, r.n_valid) for r in journal.verify(spark, str(folder), piece).collect()}
    assert got == {name: (bad, n) for name, (_, bad, n) in cases.items()}


def test_the_chain_goes_on_from_the_end_of_the_file(tmp_path):
    path = tmp_path / "j.jsonl"
    lines = chain(5, "x" * 300)
    path.write_text("\n".join(lines) + "\n\n  \n")
    assert journal._last_line(str(path), 64) == lines[-1].encode() == journal._last_line(str(path))
    journal.append(str(path), [{"timestamp": "5"}])
    assert json.loads(path.read_text().split("\n")[-2])["prev_hash"] == json.loads(lines[-1])["entry_hash"]
    path.write_text("")
    assert journal._last_line(str(path)) == b""
