"""Fill-in-middle transformation over run-length encoded texts.

A text is stored as its maximal runs of one character class, each with the
number of units (tokens, code points or lines) that are whole by its end. A cut
after so many units is found by binary search among the cumulative counts; the
place within the run follows from the width of its units by arithmetic, so a
text is never tokenised for a cut. Prefix, suffix and middle are byte slices.

Every row is transformed by itself: nothing is shuffled, and what is drawn for
a document depends on its id and the seed alone, not on the run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import documents, sha_hex

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred texts, those that are transformed; of these, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
UNITS = ("token", "character", "line")

# Classes of bytes: white space, newline (for lines), continuation bytes of UTF-8, and all others.
_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, *range(9, 14)]] = 1
_LINE = np.zeros(256, np.uint8)
_LINE[10] = 1


@dataclass
class Runs:
    """Maximal runs of one class: run i ends before byte ``ends[i]``, and ``units[i]``
    units are whole by then. In a run each unit has ``widths[i]`` bytes, or, where
    that is 0, the run holds one unit at most, which ends with it."""

    ends: np.ndarray
    units: np.ndarray
    widths: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, cut: int) -> int:
        """The byte after the first ``cut`` units, 0 for none of them."""
        if cut <= 0:
            return 0
        at = int(np.searchsorted(self.units, cut))
        width = int(self.widths[at])
        if not width:
            return int(self.ends[at])
        before = int(self.units[at - 1]) if at else 0
        start = int(self.ends[at - 1]) if at else 0
        return start + (cut - before) * width


def runs_of(data: bytes, unit: str = "token") -> Runs:
    """The runs of UTF-8 bytes.

    ``token``: ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, so a run of
    other characters ends a token, and white space does so only as the last run.
    ``character``: code points; a run has code points of one width in bytes.
    ``line``: a line ends with its newline, the last one with the text."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    if unit == "character":
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(starts, append=len(raw))
        last = np.flatnonzero(np.diff(width, append=-1))
        return Runs(np.append(starts[1:], len(raw))[last], last + 1, width[last])
    classes = (_SPACE if unit == "token" else _LINE)[raw]
    ends = np.append(np.flatnonzero(np.diff(classes)) + 1, len(raw))
    kind = classes[ends - 1]
    if unit == "token":
        whole = (kind == 0).astype(np.int64)
        whole[-1] = 1
        return Runs(ends, np.cumsum(whole), np.zeros(len(ends), np.int64))
    # the first newline of a run ends the line that runs into it, each further one is an empty line
    lengths = np.diff(ends, prepend=0)
    whole = np.where(kind == 1, lengths, 0)
    whole[-1] = lengths[-1] if kind[-1] == 1 else 1
    return Runs(ends, np.cumsum(whole), kind.astype(np.int64))


def code_points(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def parts(data: bytes, h1: int, h2: int, unit: str = "token") -> tuple[int, bytes, bytes, bytes]:
    """Number of units, then prefix, middle and suffix of a text for two drawn numbers."""
    runs = runs_of(data, unit)
    low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.offset(low), runs.offset(high)
    return runs.n, data[:a], data[a:b], data[b:]


def drawn(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits for a document; a null id draws like an empty one."""
    digest = sha_hex(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, unit: str = "token", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``,
    for ``doc_id`` and ``text``; other columns are not returned.

    Of a hundred documents, ``rate`` are rearranged, ``suffix_first`` of a hundred of these as
    ``spm`` (suffix, prefix, middle), the others as ``psm``. Texts that are empty or
    contain one of the three marks are ``plain``: the output is the text, and the
    two lengths are null. A null text counts as empty, a null doc_id draws like
    an empty one, repeated rows give the same each, cuts may fall together (an
    empty middle, prefix or suffix), and an empty table gives no rows."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    marks = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    kind = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    @arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,output:binary>")
    def arranged(data: pa.Array, form: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        rows = []
        p, s, m = marks
        for text, name, one, two in zip(data, form.to_pylist(), h1.to_pylist(), h2.to_pylist()):
            text = text.as_py()
            if name == "plain":
                rows.append({"n": runs_of(text, unit).n, "prefix_chars": None, "middle_chars": None, "output": text})
                continue
            n, prefix, middle, suffix = parts(text, one, two, unit)
            out = [s, suffix, p, prefix, m, middle] if name == "spm" else [p, prefix, s, suffix, m, middle]
            rows.append({"n": n, "prefix_chars": code_points(prefix), "middle_chars": code_points(middle), "output": b"".join(out)})
        return pa.array(rows, kind)

    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = drawn(F.col("doc_id"), seed)
    whole = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when(whole | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", form.alias("form"), arranged.asNondeterministic()(text.cast("binary"), form, h1, h2).alias("f"))
    return rows.select("doc_id", "f.n", "form", "f.prefix_chars", "f.middle_chars", F.col("f.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transformed` was made of. A rearranged text
    holds no mark, so the first one of each kind is the one that was put in."""
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    body = F.substr(head, F.lit(len(PREFIX) + 1))
    psm = [F.split_part(body, F.lit(SUFFIX), F.lit(i)) for i in (1, 2)]
    spm = [F.split_part(body, F.lit(PREFIX), F.lit(i)) for i in (2, 1)]
    return F.when(form == "psm", F.concat(psm[0], middle, psm[1])).when(form == "spm", F.concat(spm[0], middle, spm[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, a row a row of the table; null texts count as empty, repeated
    rows are transformed each for themselves, an empty table gives no rows."""
    made = transformed(documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha_hex(F.col("output")).alias("output_sha256"),
        sha_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    """DuckDB SQL of :func:`op13_fill_in_middle`: texts are cut into tokens and put together again."""
    number = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    glued = lambda a, b: f"array_to_string(tokens[{a} : {b}], '')"
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens FROM documents),
d AS (SELECT *, len(tokens) AS n, {number(0)} % (len(tokens) + 1) AS c1, {number(1)} % (len(tokens) + 1) AS c2,
  CASE WHEN text = '' OR {marked} OR {number(2)} % 100 >= {RATE} THEN 'plain' WHEN {number(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, {glued(1, 'least(c1, c2)')} AS a, {glued('least(c1, c2) + 1', 'greatest(c1, c2)')} AS b, {glued('greatest(c1, c2) + 1', 'n')} AS c FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
    ELSE '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
