"""Substring dedup by seed and extend.

A window is ``LENGTH`` consecutive words. Within every window of a text, the
k-gram with the smallest hash is its anchor (winnowing), so equal windows have
equal anchors and share a seed. Windows next to each other mostly have the same
smallest hash: an anchor stands for a run of windows, and the words that these
cover are its context, extended both ways from the seed. Text that repeats
itself, a word over and over, is one run.

1. Anchors join on the hash of their k-gram; those of one document alone go.
2. Among anchors of equal k-gram, equal contexts mean that all their windows
   are equal: a run in a document that is not the smallest with that context
   is a repeat, as a whole. Copies, however many, are settled here.
3. Where contexts differ, the runs of the smallest document of each context
   are cut into single windows, which are compared with each other.

Every step is an aggregate or an equi-join with counts, never pairs: rows grow
with the text, not with the square of a group. Texts travel compressed, once
for step 3 and once for cutting, and only anchors of shared k-grams are read
again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import Scratch, documents, join_by_count, texts_of, utf8

LENGTH, GRAM = 50, 12
SEED = 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
UNBASE = pow(BASE, -1, 1 << 64)
DIGEST = "struct<n_words:bigint,sha:string,packed:binary,anchors:array<struct<gram:bigint,context:bigint,first:bigint,last:bigint>>>"


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any run of words of a text in constant time each."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, n)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * powers[:n], dtype=np.uint64)])
        inverse = np.full(n + 1, UNBASE, np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words ``first`` to ``end`` (excluded)."""
        return _mix((self.sums[end] - self.sums[first]) * self.inverse[first] + (end - first).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` keys in a row, from minima up to and from block borders."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped, axis=1).ravel()
    back = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(words: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows of equal anchor: k-gram hash, context hash, first and last window."""
    n = len(words)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    hashes = Hashes(words)
    starts = np.arange(n - gram + 1)
    least = _least(hashes.of(starts, starts + gram), length - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    return least[first].view(np.int64), hashes.of(first, last + length).view(np.int64), first, last


def _digest(length: int, gram: int):
    @arrow_udf(DIGEST)
    def of(column: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=3)
        n, sha, packed, runs, ends = [], [], [], [], [0]
        for some in texts_of(column):
            for t in some:
                words = utf8(t).split()
                joined = b" ".join(words)
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                packed.append(squeeze.compress(joined))
                runs.append(anchors(words, length, gram))
                ends.append(ends[-1] + len(runs[-1][0]))
        each = [np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, np.int64) for i in range(4)]
        inner = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in each], names=["gram", "context", "first", "last"])
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
            names=["n_words", "sha", "packed", "anchors"],
        )

    return of.asNondeterministic()


def _unpacked(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split(b" ") if packed else []


WINDOWS = "row_id bigint, doc bigint, gram bigint, hash bigint, places array<bigint>"


def _windows(length: int):
    """Rows of single windows: for rows (row_id, doc, packed, runs), each hash
    within a text and gram once, with its places. A batch goes out a text at a
    time, so memory is that of one text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_id, doc, packed, runs = batch.columns
            for at in range(batch.num_rows):
                hashes = Hashes(_unpacked(packed[at].as_py()))
                inner = runs[at].values
                first, last = (inner.field(c).to_numpy() for c in ("first", "last"))
                size = last - first + 1
                place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                gram = np.repeat(inner.field("gram").to_numpy(), size)
                hash_ = hashes.of(place, place + length).view(np.int64)
                order = np.lexsort((place, hash_, gram))
                gram, hash_, place = gram[order], hash_[order], place[order]
                begins = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (hash_[1:] != hash_[:-1])])) if len(gram) else np.zeros(0, np.int64)
                ends = np.concatenate([begins, [len(gram)]]).astype(np.int32)
                n = len(begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row_id[at].as_py())), pa.array(np.full(n, doc[at].as_py())), pa.array(gram[begins]), pa.array(hash_[begins]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(place, pa.int64())),
                    ],
                    names=["row_id", "doc", "gram", "hash", "places"],
                )

    return of


def _cut(length: int):
    """What is left of a text without the words of the given windows."""

    @arrow_udf("struct<n_removed:bigint,sha:string,packed:binary,repeats:array<struct<first:bigint,end:bigint>>>")
    def of(packed: pa.Array, n_words: pa.Array, runs: pa.Array) -> pa.Array:
        squeeze, rows = zstandard.ZstdCompressor(level=3), []
        for at in range(len(packed)):
            edges = np.zeros(n_words[at].as_py() + 1, np.int64)
            for r in runs[at].as_py():
                edges[r["first"]] += 1
                edges[r["last"] + length] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            border = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            words = _unpacked(packed[at].as_py())
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
            rows.append({
                "n_removed": int(gone.sum()), "sha": hashlib.sha256(kept).hexdigest(), "packed": squeeze.compress(kept),
                "repeats": [{"first": int(a), "end": int(b)} for a, b in border.reshape(-1, 2)],
            })
        return pa.array(rows, pa.struct([
            ("n_removed", pa.int64()), ("sha", pa.string()), ("packed", pa.binary()),
            ("repeats", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ]))

    return of.asNondeterministic()


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows of ``docs``, and the runs of windows to remove.

    The first table has ``row_id``, ``doc_id``, ``n_words``, ``sha`` and
    ``packed``; the second ``row_id``, ``first``, ``last``: windows whose words
    also start in a row of smaller doc_id. Null ids count as smallest.
    """
    digests = docs.select("doc_id", _digest(length, gram)(F.col("text")).alias("d")).select("doc_id", "d.*")
    digests = scratch.keep(digests.withColumn("row_id", F.monotonically_increasing_id()), "digests")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    seeds = digests.select("row_id", order.alias("doc"), F.explode("anchors").alias("a")).select("row_id", "doc", "a.*")
    shared = seeds.groupBy("gram").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("context").alias("c1"), F.max("context").alias("c2"), F.count(F.lit(1)).alias("n")
    ).where("least < most").select("gram", "n", "least", (F.col("c1") < F.col("c2")).alias("mixed"))
    met = scratch.keep(join_by_count(seeds, scratch.keep(shared, "shared"), ["gram"]), "met")
    plain = met.where(~F.col("mixed") & (F.col("doc") > F.col("least"))).select("row_id", "first", "last")

    # Members of one class within one input partition travel as one row, so that a
    # hot context costs as many rows as there are partitions, not documents.
    mixed = met.where("mixed").withColumn("part", F.shiftright("row_id", 33))
    classes = mixed.groupBy("gram", "context", "part").agg(
        F.min("doc").alias("least"), F.collect_list(F.struct("row_id", "doc", "first", "last")).alias("members")
    )
    classes = scratch.keep(classes, "classes")
    owners = classes.groupBy("gram", "context").agg(F.min("least").alias("owner"))
    owned = classes.join(owners, ["gram", "context"]).select("gram", "owner", F.explode("members").alias("m")).select("gram", "owner", "m.*")
    owned = scratch.keep(owned, "owned")
    copied = owned.where("doc > owner").select("row_id", "first", "last")

    runs = owned.where("doc = owner").groupBy("row_id", "doc").agg(F.collect_list(F.struct("gram", "first", "last")).alias("runs"))
    texts = digests.select("row_id", "packed")
    single = texts.join(runs, "row_id").select("row_id", "doc", "packed", "runs").mapInArrow(_windows(length), WINDOWS)
    single = scratch.keep(single, "windows")
    seen = single.groupBy("gram", "hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    seen = scratch.keep(seen.drop("most"), "seen")
    again = join_by_count(single, seen, ["gram", "hash"]).where("doc > least").select("row_id", F.explode("places").alias("first"))
    again = again.select("row_id", "first", F.col("first").alias("last"))
    found = scratch.keep(plain.unionByName(copied).unionByName(again), "found")
    scratch.free("shared", "met", "classes", "owned", "windows", "seen")
    return digests, found


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove words in windows that also start in a row of smaller doc_id.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are
    runs of anything but ASCII white space, unchanged; a window is ``length``
    consecutive ones; all are judged on the input. Returns, for every row,
    ``row_id``, ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the
    kept words joined by one space), ``sha`` (of all words joined so),
    ``repeats`` (removed ranges of words) and ``packed`` (Zstandard of the kept
    words joined; null where nothing was removed). Null, empty and short texts lose nothing. Rows of the same doc_id
    are no source for each other; null ids count as the smallest. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    digests, found = repeats(docs, scratch, length, gram)
    runs = found.groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = digests.select("row_id", "n_words", "packed").join(runs, "row_id")
    cut = cut.select(F.col("row_id").alias("cut_id"), _cut(length)(F.col("packed"), F.col("n_words"), F.col("runs")).alias("c"))
    both = digests.select("row_id", "doc_id", "n_words", "sha").join(cut, F.col("row_id") == F.col("cut_id"), "left")
    return both.select(
        "row_id", "doc_id", "n_words", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("c.sha", "sha").alias("kept_sha256"), F.coalesce("c.repeats", F.array().cast("array<struct<first:bigint,end:bigint>>")).alias("repeats"),
        "sha", F.col("c.packed").alias("packed"),
    )


@arrow_udf(StringType())
def _sha(column: pa.Array) -> pa.Array:
    """SHA-256 of a text's words joined by one space, as in :func:`_digest`."""
    return pa.array([hashlib.sha256(b" ".join(utf8(t).split())).hexdigest() for some in texts_of(column) for t in some], pa.string())


@arrow_udf(StringType())
def _text(packed: pa.Array) -> pa.Array:
    return pa.array([None if p is None else zstandard.decompress(p).decode("utf-8", "replace") for p in packed.to_pylist()], pa.string())


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed, columns as they were.

    A text that lost words becomes its kept words joined by one space, with
    ``n_chars`` to match; a row that lost all of them goes; other rows stay as
    they are. What a row loses follows from its doc_id and its words, so rows
    that share a doc_id are told apart by a digest of their words; rows of null
    doc_id are the smallest and lose nothing. Columns may have any names and
    keep their types; null and empty texts stay; an empty table gives no rows.
    """
    found = dedup(docs).where("n_removed > 0").select(
        F.col("doc_id").alias("id"), F.col("sha").alias("cut"), "packed", (F.col("n_removed") == F.col("n_words")).alias("gone")
    ).dropDuplicates(["id", "cut"])
    words = docs.select(F.struct(*docs.columns).alias("doc"), _sha(F.col("text")).alias("words"))
    both = words.join(found, (F.col("doc.doc_id") == F.col("id")) & (F.col("words") == F.col("cut")), "left").where(~F.coalesce("gone", F.lit(False)))
    both = both.withColumn("kept", F.when(F.col("packed").isNotNull(), _text(F.col("packed"))))
    text = F.when(F.col("packed").isNull(), F.col("doc.text")).otherwise(F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("packed").isNull(), F.col("doc.n_chars")).otherwise(F.length("kept"))} if "n_chars" in docs.columns else {"text": text}
    kinds = dict(docs.dtypes)
    return both.select(*((new[c].cast(kinds[c]) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``. Null,
    empty and short texts lose nothing; repeated rows stay as often as they
    are; an empty table gives no rows."""
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def oracle_sql(length: int = LENGTH) -> str:
    """DuckDB SQL of :func:`op7_substring_dedup`."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i : i + {length - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {length - 2}))) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS p FROM win JOIN least USING (h) WHERE doc_id > m),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce((SELECT string_agg(u.word, ' ' ORDER BY u.p) FROM (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS p) u
      WHERE NOT list_contains(ps, u.p)), '') END) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""
