"""SimHash near-dedup over a byte-position inverted index.

A fingerprint has eight positional bytes. Two that differ in at most three
bits agree in at least five of them (``LEAST_SHARED``), so only pairs with that
many shared positional bytes can link. The index keys postings by three
positional bytes: positions 0-3 and 4-7 form two halves, five shared positions
put three into one of them, so the eight triples within a half miss no pair.
The shared bytes of each pair met in a posting list are tallied, pairs under
the guaranteed minimum go, and the rest is verified by counting differing bits.

Long posting lists are never paired up as they are. Their members are keyed
again by five positional bytes, and lists that are still long are resolved in
linear time: what remains are three bytes, and two members within three bits
have a common neighbour that is one bit from the one and two bits from the
other. Members meet at these neighbours and link to the smallest one there,
which loses no reachability and emits no pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import ASCII_LOWER, Scratch, documents, join_by_count, texts_of, utf8
from .components import smallest_reachable

#: Fixed by the fingerprint: bits, positional bytes, most differing bits.
BITS, BYTES, DISTANCE = 64, 8, 3
LEAST_SHARED = BYTES - DISTANCE
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text; see :func:`fingerprints`."""
    words = utf8(text).translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """SimHash of whole texts as a signed 64-bit column.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and
    every shingle counts, repeats included. Texts of fewer words than a shingle
    have one shingle, their whole word sequence; null, empty and blank texts
    have the fingerprint 0.
    """

    @arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        values = [fingerprint(t, shingle) for some in texts_of(column) for t in some]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return of(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _key(fp: Column, positions: tuple[int, ...]) -> Column:
    return reduce(lambda k, p: F.shiftleft(k, 8).bitwiseOR(_byte(fp, p)), positions, F.lit(0).cast("long"))


def _shared(a: Column, b: Column) -> Column:
    """The tally: positional bytes that two fingerprints share."""
    return reduce(lambda n, p: n + F.when(_byte(a, p) == _byte(b, p), 1).otherwise(0), range(BYTES), F.lit(0))


def _postings(fps: DataFrame, subsets: list[tuple[int, ...]], kept: str | None = None) -> DataFrame:
    """Rows (slot, bytes, fp): one for each subset of positions. With ``kept``,
    only for subsets that hold the triple of that number, which is a column."""
    slots = [F.struct(F.lit(i).alias("slot"), _key(F.col("fp"), s).alias("bytes")) for i, s in enumerate(subsets)]
    if kept:
        slots = [F.when(F.col(kept).isin([t for t, x in enumerate(TRIPLES) if {*x} <= {*s}]), x) for s, x in zip(subsets, slots)]
        listed = F.filter(F.array(*slots), lambda x: x.isNotNull())
    else:
        listed = F.array(*slots)
    return fps.select("fp", F.explode(listed).alias("p")).select("p.slot", "p.bytes", "fp").distinct()


def _lists(postings: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Postings of lists with company, with the length of the list as ``length``; written."""
    lengths = postings.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = scratch.keep(lengths.withColumn("length", F.col("n")), f"lengths_{name}")
    return scratch.keep(join_by_count(postings, lengths, ["slot", "bytes"]), f"lists_{name}")


def _pairs(lists: DataFrame) -> DataFrame:
    """Verified links (u, v) within short lists."""
    a, b = lists.select("slot", "bytes", F.col("fp").alias("u")), lists.select("slot", "bytes", F.col("fp").alias("v"))
    tallied = a.join(b, ["slot", "bytes"]).where("u < v").where(_shared(F.col("u"), F.col("v")) >= LEAST_SHARED)
    return tallied.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")


def _flips(subsets: list[tuple[int, ...]]) -> list[tuple[int, int, bool]]:
    """Rows (slot, mask, near): all ways to flip up to two bits outside the
    positions of a slot; near ones flip one at most. Fixed by the fingerprint:
    56 slots of 24 bits make 16,856 rows."""
    rows = []
    for slot, s in enumerate(subsets):
        bits = [8 * p + i for p in range(BYTES) if p not in s for i in range(8)]
        for k in range(3):
            for some in combinations(bits, k):
                m = sum(1 << b for b in some)
                rows.append((slot, m - (1 << 64) if m >> 63 else m, k < 2))
    return rows


def _stars(lists: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """Links within long lists, through common neighbours; see the module."""
    masks = F.broadcast(lists.sparkSession.createDataFrame(_flips(subsets), "slot int, m long, near boolean"))
    met = lists.join(masks, "slot").select(
        "slot", "bytes", F.col("fp").bitwiseXOR(F.col("m")).alias("at"), "fp", "near"
    )
    centre = met.where("near").groupBy("slot", "bytes", "at").agg(F.min("fp").alias("v"))
    return met.join(centre, ["slot", "bytes", "at"]).where("fp <> v").select(F.col("fp").alias("u"), "v")


def links(fps: DataFrame, scratch: Scratch, longest: int = 64) -> DataFrame:
    """Links (u, v), u < v, each once, among distinct fingerprints ``fp``: every
    pair at three or fewer differing bits is linked, directly or through links
    that are themselves at most three bits long. ``longest`` is the length of
    posting list above which members are keyed again instead of paired; it
    changes the work and which links stand for the others, not what can be
    reached."""
    lists = _lists(_postings(fps, TRIPLES), scratch, "3")
    short, long_ = lists.where(F.col("length") <= longest), lists.where(F.col("length") > longest)
    found = _pairs(short)
    if not long_.isEmpty():
        fives = list(combinations(range(BYTES), LEAST_SHARED))
        keyed = _postings(long_.select("fp", F.col("slot").alias("triple")).distinct(), fives, "triple")
        deeper = _lists(keyed, scratch, "5")
        found = found.unionByName(_pairs(deeper.where(F.col("length") <= longest)))
        rest = deeper.where(F.col("length") > longest)
        if not rest.isEmpty():
            found = found.unionByName(_stars(rest, fives))
    ordered = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return scratch.keep(ordered.distinct(), "links")


def _named(nodes: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes (``fp``, ``least``, ``n``) with the smallest ``least`` of their component."""
    roots = scratch.keep(smallest_reachable(found, scratch), "roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    label = rooted.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
    label = scratch.keep(label, "labels")
    return join_by_count(rooted.select("fp", F.col("n").alias("rows"), "root"), label, ["root"])


def near_duplicates(docs: DataFrame, shingle: int = 3, longest: int = 64) -> DataFrame:
    """Component of near-duplicate texts for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    ``doc_id``, ``fp`` (signed), ``fingerprint`` (16 hex digits) and
    ``component_id`` (smallest doc_id reachable over links of at most three
    differing bits, itself included). Equal fingerprints are one node, so
    copies cost one row, not pairs. Repeated rows come back as often as they
    came in; a null doc_id takes part but is never a component_id unless a
    component has no other. Empty tables give empty tables.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "prints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    named = _named(nodes, links(nodes.select("fp"), scratch, longest), scratch)
    named = scratch.keep(named.select("fp", F.col("rows").alias("n"), F.col("least").alias("component_id")), "named")
    return join_by_count(prints, named, ["fp"]).select("doc_id", "fp", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, whatever its id.

    The row of the smallest doc_id stays, of rows that repeat it the first by
    number; a row of null doc_id only where a component has no other. Rows are
    numbered once, in a written table, and kept by number: rows that have no id,
    or share one, and are not linked all stay. Null, empty and blank texts have
    one fingerprint, so one of them stays. Columns are as they were, whatever
    their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    numbered = whole.withColumn("fp", fingerprints(F.col("doc.text"))).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(numbered, "rows")
    place = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), "row")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    stay = _named(nodes, links(nodes.select("fp"), scratch), scratch).select(F.col("least.row").alias("row")).distinct()
    return rows.join(stay, "row", "left_semi").select("doc.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: ``doc_id``, ``fingerprint``, ``component_id``. Null, empty and
    blank texts have fingerprint zero and are linked like any other; repeated
    rows stay as often as they are; an empty table gives no rows."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
