"""Hash-chained append-only journals: reading, verifying, appending.

A journal may be larger than a task. Files are read in byte ranges that Spark
cuts at line ends; lines are numbered by the counts of the ranges before them.
Links are checked inside pieces of ``PIECE`` places; the first entry of a piece is
held against the last one of the pieces before, of which there is one row each.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.scratch import written

# The entry's fields in their order, and the hash before the first entry.
REQUIRED = ["timestamp", "principal", "action", "resource", "cedar_decision", "prev_hash", "entry_hash"]
FIELDS = ["timestamp", "principal", "action", "resource", "cedar_decision", "envelope_id", "prev_hash", "entry_hash"]
GENESIS = "0" * 64
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
#: Places of a journal in a piece.
PIECE = 100_000


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines files; lines that are no entry, or lack one of its
    required fields, are dropped."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna(subset=REQUIRED)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with ``journal`` (the file) and 0-based ``ordinal``, blank lines counted.

    A file is read in ranges of ``spark.sql.files.maxPartitionBytes`` at most. Within one, lines have consecutive numbers as they are
    read, so the range's smallest number and the lines before the range give the
    ordinal. The text is read twice, once to count; no line is shuffled unless
    there are more ranges than a broadcast holds. Empty files have no lines."""
    text = spark.read.text(path, lineSep="\n")
    placed = text.select(F.col("_metadata.file_path").alias("journal"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    ranges = placed.groupBy("journal", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("journal").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(ranges.select(F.col("journal").alias("_journal"), F.col("range").alias("_range"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift")), "ranges")
    both = placed.join(starts, (F.col("journal") == F.col("_journal")) & (F.col("range") == F.col("_range")))
    return both.select("journal", (F.col("place") + F.col("_shift")).alias("ordinal"), "line")


def parsed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines as entries with ``bad`` for lines that do not parse; blank lines go."""
    rows = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE"}))
    rows = rows.select("journal", "ordinal", "line", "e.*", reduce(lambda a, b: a | b, (F.col(f"e.{f}").isNull() for f in REQUIRED)).alias("bad"))
    return rows if strict else rows.where(~F.col("bad"))


def body_of(line: Column) -> Column:
    """The stored text with its own hash blanked: hashes are over text, never over re-rendered values."""
    return F.regexp_replace(line, r'"entry_hash":"[^"]*"', '"entry_hash":""')


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def hashed(entries: DataFrame, body: Column | None = None) -> DataFrame:
    """``hash_ok``: the own hash is that of previous hash, a bar and the body."""
    own = F.sha2(F.concat("prev_hash", F.lit("|"), body if body is not None else body_of(F.col("line"))), 256)
    return entries.withColumn("hash_ok", _false(own == F.col("entry_hash")))


def linked(entries: DataFrame, by: str = "journal", order: str = "ordinal", piece: int = PIECE) -> DataFrame:
    """``link_ok``: the previous hash is that of the entry before, or genesis for a journal's first entry.

    ``order`` is a whole number that tells the entries of a journal apart, and may have gaps. ``entries`` is read
    twice: once for the last hash of each piece."""
    cut = entries.withColumn("_piece", F.floor(F.col(order) / piece))
    inside = Window.partitionBy(by, "_piece").orderBy(order)
    last = cut.groupBy(by, "_piece").agg(F.max_by("entry_hash", order).alias("_last"))
    ends = last.select(F.col(by).alias("_by"), F.col("_piece").alias("_at"), F.lag("_last").over(Window.partitionBy(by).orderBy("_piece")).alias("_end"))
    rows = cut.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag("entry_hash").over(inside))
    both = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")) & F.col("_piece").eqNullSafe(F.col("_at")))
    before = F.coalesce(F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_lag")), F.lit(GENESIS))
    return both.withColumn("link_ok", _false(F.col("prev_hash") == before)).drop("_piece", "_n", "_lag", "_by", "_at", "_end")


def links(entries: DataFrame, by: str = "journal", order: str = "ordinal", body: Column | None = None, piece: int = PIECE) -> DataFrame:
    """``link_ok`` and ``hash_ok`` for each entry; see :func:`linked` and :func:`hashed`."""
    return linked(hashed(entries, body), by, order, piece)


def first_break(checked: DataFrame, by: str = "journal", order: str = "ordinal", piece: int = PIECE) -> DataFrame:
    """For each journal the place of its first bad line (null if sound) and the number of entries before it.

    Each piece is judged by itself; a journal's pieces, a row each, are then put together."""
    bad = ~(F.col("link_ok") & F.col("hash_ok"))
    cut = checked.select(by, F.col(order).alias("_o"), F.floor(F.col(order) / piece).alias("_piece"), bad.alias("_bad"))
    marked = cut.withColumn("_first", F.min(F.when(F.col("_bad"), F.col("_o"))).over(Window.partitionBy(by, "_piece")))
    sound = F.count_if(F.coalesce(F.col("_o") < F.col("_first"), F.lit(True)))
    pieces = marked.groupBy(by, "_piece").agg(F.min("_first").alias("_first"), sound.alias("_sound"))
    broken = F.min(F.when(F.col("_first").isNotNull(), F.col("_piece"))).over(Window.partitionBy(by))
    counted = pieces.withColumn("_broken", broken).where("_broken IS NULL OR _piece <= _broken")
    return counted.groupBy(by).agg(F.min("_first").alias("first_bad"), F.sum("_sound").alias("n_valid"))


def verify(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Verdict on every journal file: ``first_bad`` line and ``n_valid`` entries.

    Lines are parsed and hashed as they are read; hashes and places alone are written and checked further."""
    entries = hashed(parsed(read_lines(spark, path))).select("journal", "ordinal", "prev_hash", "entry_hash", "hash_ok")
    return first_break(linked(written(entries, "entries"), piece=piece), piece=piece)


def entry_line(entry: dict, prev_hash: str) -> str:
    """An entry as a line, with its hashes."""
    body = {f: entry.get(f) for f in FIELDS} | {"prev_hash": prev_hash, "entry_hash": ""}
    text = json.dumps(body, separators=(",", ":"), ensure_ascii=False)
    own = hashlib.sha256(f"{prev_hash}|{text}".encode()).hexdigest()
    return json.dumps(body | {"entry_hash": own}, separators=(",", ":"), ensure_ascii=False)


def _last_line(path: str, step: int = 1 << 16) -> bytes:
    """The last line of a file that is not blank, read from its end."""
    with open(path, "rb") as f:
        at, tail = f.seek(0, 2), b""
        while at and b"\n" not in tail.strip():
            size = min(step, at)
            at = f.seek(at - size)
            tail = f.read(size) + tail
    return tail.strip().rsplit(b"\n", 1)[-1]


def append(path: str, entries: list[dict]) -> str:
    """Append entries to one journal file in order, and return the last hash.

    A chain is a fold over its order, so this runs on the driver, one writer a file; of what the file has, the end is read."""
    try:
        last_line = _last_line(path)
    except FileNotFoundError:
        last_line = b""
    last = json.loads(last_line)["entry_hash"] if last_line else GENESIS
    with open(path, "a", encoding="utf-8") as f:
        for entry in entries:
            line = entry_line(entry, last)
            last = json.loads(line)["entry_hash"]
            f.write(line + "\n")
    return last


def embedding_text(entries: DataFrame) -> DataFrame:
    """What recall embeds: principal, action, resource and decision, joined."""
    return entries.withColumn("text", F.concat_ws(" ", "principal", "action", "resource", "cedar_decision"))
