"""Best-fit packing of token sequences, bulk-synchronously.

Pieces of documents are tokenised and cut where they are longer than a
sequence. Packing then runs in rounds over documents and gaps (the room that
open sequences have left), both kept in runs of equal size, sorted by size:

1. Runs are dealt to ranges of size. Each range is swept from its largest size
   down: gaps are laid on a stack, so that pieces of a length meet the tightest
   gap that still holds them, their successor. A gap takes as many pieces of a
   length as fit.
2. Pieces of one length that want gaps of one size are told apart by rank: a
   run of ranks goes to a run of sequences. Gaps get their new size.
3. What the ranges could not match, pieces longer than a range's gaps and gaps
   that it had no piece for, is swept over all ranges, until no piece fits.
4. Sequences are opened, as many as what is left would fill, and the next round
   begins.

Lengths and gaps are whole numbers up to the capacity, so a round's table has
as many runs as there are sizes and splits, whatever the input; it is a written
table, and the driver sees two numbers a round. What grows with the input, the
tokens, the counts, the ranks within a length and the placing of pieces by
rank, is distributed, too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import Scratch, documents, number_within, texts_of
from .wordpiece import public_path, word_bpe

CAPACITY = 2048
SEPARATOR = b"\0\0\0\0"


def pieces(text: Column, path: str, capacity: int = CAPACITY) -> Column:
    """Array of pieces (piece, start, length, ids_crc32) of a whole text: its
    ids and the separator 0, cut into ``capacity`` ids. Null is empty, so that
    every row has at least one piece."""

    @arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def of(column: pa.Array) -> pa.Array:
        bpe, step = word_bpe(path), 4 * capacity
        begins, start, length, crc = [0], [], [], []
        for some in texts_of(column):
            for t in some:
                data = bpe.ids(t) + SEPARATOR
                for at in range(0, len(data), step):
                    piece = data[at : at + step]
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                begins.append(len(start))
        ends = np.array(begins)
        number = np.arange(len(start)) - np.repeat(ends[:-1], np.diff(ends))
        rows = pa.StructArray.from_arrays(
            [pa.array(number.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["piece", "start", "length", "ids_crc32"],
        )
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)

    return of(text)


#: A run: pieces of a length (ranks from ``first``), gaps of a size (sequences
#: from ``first``), gaps made in this round, or placed pieces (``first`` rank
#: of ``size``, in sequences from ``sequence`` at ``offset``).
RUN = "kind string, size int, first long, count long, sequence long, offset long"
Run = tuple[str, int, int, int, int, int]


def sweep(runs: list[Run], capacity: int = CAPACITY) -> list[Run]:
    """One sweep from the largest size down; see the module. Runs that are
    placed or made in this round go through."""
    out = [r for r in runs if r[0] in ("made", "placed")]
    open_ = sorted((r for r in runs if r[0] in ("gap", "piece")), key=lambda r: (-r[1], r[0], -r[2]))
    stack: list[list[int]] = []  # [size, first sequence, count], the tightest on top
    for kind, size, first, count, _, _ in open_:
        if kind == "gap":
            stack.append([size, first, count])
            continue
        while count and stack:
            room, at, n = stack[-1]
            fits = room // size
            used = min(n, count // fits) or 1
            taken = min(fits, count)  # pieces in each of the ``used`` gaps
            for layer in range(taken):
                out.append(("placed", size, first + layer * used, used, at, capacity - room + layer * size))
            if room > taken * size:
                out.append(("made", room - taken * size, at, used, 0, 0))
            first, count = first + taken * used, count - taken * used
            if used == n:
                stack.pop()
            else:
                stack[-1][1:] = at + used, n - used
        if count:
            out.append(("piece", size, first, count, 0, 0))
    return out + [("gap", size, at, n, 0, 0) for size, at, n in stack]


def settle(runs: list[Run], capacity: int = CAPACITY) -> list[Run]:
    """Sweeps, each over the gaps that the one before has made, until nothing fits."""
    placed: list[Run] = []
    while True:
        done = sweep([r if r[0] != "made" else ("gap", *r[1:]) for r in runs if r[0] != "placed"], capacity)
        placed += [r for r in runs if r[0] == "placed"]
        if not any(r[0] == "placed" for r in done):
            return placed + done
        runs = done


def _swept(runs: DataFrame, by: Column, how: Callable[[list[Run], int], list[Run]], capacity: int) -> DataFrame:
    """:func:`sweep` or :func:`settle` for the runs of each ``by``."""
    names, types = zip(*(c.split() for c in RUN.split(", ")))
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in zip(names, types)])

    def of(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in names)))
        return pa.table(list(map(list, zip(*how(rows, capacity)))), schema=schema)

    return runs.select(by.alias("range"), *names).groupBy("range").applyInArrow(of, RUN)


def plan(counts: DataFrame, scratch: Scratch, capacity: int = CAPACITY, ranges: int = 4) -> DataFrame:
    """Placement of pieces by (``length``, ``rank`` within the length).

    ``counts`` has ``length`` and ``n``. Returns ``length``, ``rank``, ``count``,
    ``sequence`` and ``offset``: ``count`` ranks from ``rank`` take sequences
    from ``sequence``, each at ``offset``.
    """
    pieces_ = counts.select(F.lit("piece").alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").alias("count"), F.lit(0).cast("long").alias("sequence"), F.lit(0).cast("long").alias("offset"))
    spark, half = counts.sparkSession, F.col("length") * 2 > capacity
    row = counts.agg(F.sum("n").alias("left"), F.sum(F.when(half, F.col("n"))).alias("large"), F.sum(F.col("n") * F.col("length")).alias("volume")).first()
    left, volume, opened = row.left or 0, row.volume or 0, 0
    runs, turn, placed = pieces_, 0, []
    more = row.large or -(-volume // capacity)
    while left:
        if more:
            opened_ = spark.createDataFrame([("gap", capacity, opened, more, 0, 0)], RUN)
            runs, opened = runs.unionByName(opened_), opened + more
        ranged = _swept(runs, F.floor(F.col("size") * ranges / (capacity + 1)), sweep, capacity)
        rest, told = F.col("kind") == "piece", Observation()
        settled = _swept(ranged, F.lit(0), settle, capacity).observe(
            told, F.sum(F.when(rest, F.col("count"))).alias("left"), F.sum(F.when(rest, F.col("count") * F.col("size"))).alias("volume")
        )
        done, fresh = scratch.keep(settled, f"round_{turn}"), F.col("kind") == "placed"
        left, volume = told.get["left"] or 0, told.get["volume"] or 0
        more = max(1, volume // capacity)
        placed.append(done.where(fresh))
        runs = done.where(~fresh)
        turn += 1
    all_ = reduce(DataFrame.unionByName, placed) if placed else pieces_.limit(0)
    return all_.select(F.col("size").cast("long").alias("length"), F.col("first").alias("rank"), "count", "sequence", "offset")


def placed_by_rank(ranked: DataFrame, placement: DataFrame, block: int = 4096) -> DataFrame:
    """``ranked`` (``length``, ``rank``, ...) with ``sequence_id`` and ``offset``: runs
    of ranks are cut at multiples of ``block``, so that this is an equi-join on
    (length, block of ranks) and no key has more than ``block`` rows."""
    cut = placement.select("*", F.explode(F.sequence(F.floor(F.col("rank") / block), F.floor((F.col("rank") + F.col("count") - 1) / block))).alias("_block"))
    cut = cut.select(F.col("length").alias("_length"), "_block", F.col("rank").alias("_first"), (F.col("rank") + F.col("count")).alias("_end"), "sequence", F.col("offset").alias("_offset"))
    inside = (F.col("length") == F.col("_length")) & (F.floor(F.col("rank") / block) == F.col("_block")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end"))
    both = ranked.join(cut, inside)
    return both.select(*ranked.columns, (F.col("sequence") + F.col("rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``: one row for every piece of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts are one piece, the separator alone. Rows that repeat a doc_id
    are packed each for themselves. ``path`` is the tokenizer's file, which
    every executor has. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = docs.select("doc_id", F.explode(pieces(F.col("text"), path or public_path(), capacity)).alias("p"))
    cut = scratch.keep(cut.select("doc_id", "p.*"), "pieces")
    counts = scratch.keep(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "counts")
    placement = scratch.keep(plan(counts, scratch, capacity), "placement")
    ranked = number_within(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", scratch)
    return placed_by_rank(ranked, placement).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, a row a piece. Null and empty texts are one piece each,
    repeated rows are packed each for themselves, an empty table gives no rows."""
    return pack(documents(spark, sf_dir))
