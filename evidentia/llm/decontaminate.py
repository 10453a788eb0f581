"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of the benchmark (13 consecutive words of an item, or the whole
item where it is shorter) become the keys of one automaton over normalised
text. Each document is normalised the same way and scanned once; a match is
mapped from its place in the normalised text to words, and to bytes of the
original text. Documents without a match cost the scan alone.

The automaton travels to the executors, so its size is bounded: items are dealt
by hash to blocks of about ``most_windows`` words. A benchmark of one block, the
usual case, is one pass. A larger one is scanned in passes, a block each: only
one block is on the driver, and only one automaton in a worker, at a time. A
pass leaves a row for each document with hits (the first one for each with
words); hits are united at the end, and places in the original text follow from
the united ones, so that they don't depend on the number of passes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import ASCII_WORDS, Scratch, documents, texts_of, utf8

WINDOW = 13
WORD = re.compile(rb"[^ ]+")
SPANS = "array<struct<start:bigint,end:bigint>>"
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = f"n_words:bigint,n_hit:bigint,items:array<string>,spans:{SPANS},hits:{SPANS}"
MOST_WINDOWS = 200_000  # of one automaton: 4.3 kB each


def normalise(text: str | None) -> bytes:
    """Lower-cased ASCII words joined by one space, with one space at each end."""
    return b" " + b" ".join(utf8(text).translate(ASCII_WORDS).split()) + b" "


def windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Window -> ids of the items that hold it; see :func:`contamination`."""
    found: dict[str, dict[str, None]] = defaultdict(dict)
    for item_id, text in items:
        words = normalise(text).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[(b" " + b" ".join(words[i : i + window]) + b" ").decode("latin-1")][item_id] = None
    return {w: list(ids) for w, ids in found.items()}


class Scanner:
    """The automaton over the windows of some items, built once in each Python worker."""

    _built: dict[str, ahocorasick.Automaton] = {}

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.items, self.window = items, window
        self.key = hashlib.sha256(repr((items, window)).encode()).hexdigest()

    def automaton(self) -> ahocorasick.Automaton:
        if self.key not in self._built:
            self._built.clear()
            made = ahocorasick.Automaton()
            for text, ids in windows(self.items, self.window).items():
                made.add_word(text, (len(text), ids))
            if len(made):
                made.make_automaton()
            self._built[self.key] = made
        return self._built[self.key]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit ranges of words, ids of the items that occur."""
        low = normalise(text)
        n = low.count(b" ") - 1 if len(low) > 2 else 0
        automaton = self.automaton()
        if not n or not len(automaton):
            return n, [], set()
        places, ids = [], set()
        for end, (length, found) in automaton.iter(low.decode("latin-1")):
            places.append((end - length + 1, end))
            ids.update(found)
        if not places:
            return n, [], ids
        spaces = np.flatnonzero(np.frombuffer(low, np.uint8) == 32)
        return n, merged((int(np.searchsorted(spaces, s)), int(np.searchsorted(spaces, e))) for s, e in places), ids


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_offsets(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges in the UTF-8 of the original text for ranges of words."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(utf8(text).translate(ASCII_WORDS))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def scanners(benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> Iterator[Scanner]:
    """A scanner for each block of a benchmark table (``item_id``, ``text``), one at a
    time on the driver. A block has about ``most_windows`` words, or one item.
    Items of null text have no words; an item of null id has windows, but is in
    no list of items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * most_windows)))  # a word and what parts it from the next have 6 bytes or so
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield Scanner(sorted(((r.id, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or "")), window)


def contamination(text: Column, scanner: Scanner) -> Column:
    """Struct of ``n_words``, ``n_hit`` (words inside a window of any item),
    ``items`` (sorted ids of the items whose windows occur), ``spans`` (byte
    ranges of the hits in the original text) and ``hits`` (their words, from 0).
    Null and empty texts have no words and no hit."""
    shared = SparkSession.active().sparkContext.broadcast(scanner)  # a block of the benchmark

    @arrow_udf(f"struct<{RESULT}>")
    def of(column: pa.Array) -> pa.Array:
        scan, rows = shared.value.scan, []
        for some in texts_of(column):
            for t in some:
                n, ranges, ids = scan(t)
                rows.append({
                    "n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": sorted(i for i in ids if i is not None),
                    "spans": [{"start": a, "end": b} for a, b in original_offsets(t, ranges)], "hits": [{"start": a, "end": b} for a, b in ranges],
                })
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPAN_ARROW), ("hits", SPAN_ARROW)]))

    return of.asNondeterministic()(text)


def placed(text: Column, hits: Column) -> Column:
    """Struct of ``n_hit``, ``spans`` and ``hits`` for the hit ranges of words that several
    automata found in a text: they are united first, and spans are taken from
    the united ones, as one automaton for all would."""
    kind = pa.struct([("n_hit", pa.int64()), ("spans", SPAN_ARROW), ("hits", SPAN_ARROW)])

    @arrow_udf(f"struct<n_hit:bigint,spans:{SPANS},hits:{SPANS}>")
    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for t, some in zip(texts, found):
            ranges = merged((r["start"], r["end"]) for r in some.as_py() or [])
            rows.append({
                "n_hit": sum(b - a for a, b in ranges), "hits": [{"start": a, "end": b} for a, b in ranges],
                "spans": [{"start": a, "end": b} for a, b in original_offsets(t.as_py() if ranges else None, ranges)],
            })
        return pa.array(rows, kind)

    return of.asNondeterministic()(text, hits)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Rows of ``docs`` as a struct ``doc``, with ``found``; see :func:`contamination`."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    all_ = iter(scanners(benchmark, window, most_windows))
    first, second = next(all_), next(all_, None)
    if second is None:
        return whole.withColumn("found", contamination(F.col("doc.text"), first))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = scratch.keep(whole.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    parts = []
    for turn, scanner in enumerate(chain([first, second], all_)):
        found = rows.select("row_id", contamination(F.col("doc.text"), scanner).alias("f")).where((F.col("f.n_words") > 0) & ((F.col("f.n_hit") > 0) | F.lit(turn == 0)))
        parts.append(scratch.keep(found.select("row_id", "f.n_words", "f.items", "f.hits"), f"pass_{turn}"))
    met = reduce(DataFrame.unionByName, parts).groupBy(F.col("row_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"),
    )
    joined = rows.join(met, rows.row_id == met._row, "left").select("doc", F.coalesce("n_words", F.lit(0).cast("long")).alias("n"), F.coalesce("items", F.array().cast("array<string>")).alias("i"), placed(F.col("doc.text"), F.col("hits")).alias("p"))
    return joined.select("doc", F.struct(F.col("n").alias("n_words"), "p.n_hit", F.col("i").alias("items"), "p.spans", "p.hits").alias("found"))


def is_contaminated(found: Column) -> Column:
    """At least one hit, and hits are a twentieth of the words or more."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items``, ``spans``, ``hits``, ``contaminated``
    for every row of ``docs``; rows that repeat are judged each for themselves,
    other columns are ignored, empty tables give no rows or no hits."""
    found = judged(docs.select("doc_id", "text"), benchmark, window, most_windows)
    return found.select("doc.doc_id", "found.*", is_contaminated(F.col("found")).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` without the contaminated rows; columns are as they were, whatever
    their names. Null and empty texts stay; empty tables give no rows or take
    none away."""
    return judged(docs, benchmark, window, most_windows).where(~is_contaminated(F.col("found"))).select("doc.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``, a row a document row; null texts have
    no words; empty tables give no rows or no hits."""
    found = scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of :func:`op9_decontaminate`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH dw AS (SELECT doc_id, {words} AS w FROM documents),
iw AS (SELECT item_id, {words} AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), {window}) AS k, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iwin),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT d.doc_id, d.i, d.k, b.item_id FROM dwin d JOIN iwin b USING (k, win)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, CAST(i + k AS BIGINT))) FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
