"""Points in spans of lines: an index of dyadic pieces, joined on equal keys.

A span is cut into its maximal aligned pieces, each 2^level lines long: at most
two a level, so a span of n lines has at most 2 log2 n of them, whatever n is. A
point lies in one piece of each level; it probes the levels that spans use, and
every hit is inside its span: nothing is compared afterwards. Spans of one piece
are reduced to the best one before points come, so many spans around a line
cost one row, and points of one line are one probe.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.joins import join_by_count
from evidentia.scratch import Scratch

#: Pieces from this level on may hold many points: they are there once a salt.
WIDE, SALTS = 16, 32


def pieces(first: Column, last: Column) -> Column:
    """Maximal aligned pieces of the lines ``first`` to ``last`` as an array of (level, at):
    the lines at * 2^level to (at + 1) * 2^level - 1. Null and inverted spans have none."""
    a, end = first.cast("long"), last.cast("long") + 1

    def of(level: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("shiftright", a + step - 1, level), F.call_function("shiftright", end, level)
        piece = lambda at: F.struct(level.alias("level"), at.alias("at"))
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        inside = low < high
        return F.array(F.when(inside & odd(low), piece(low)), F.when(inside & odd(high), piece(high - 1)))

    levels = F.sequence(F.lit(0), F.length(F.bin(end - a)))
    return F.when(end > a, F.array_compact(F.flatten(F.transform(levels, of))))


def _salts(level: Column) -> Column:
    return F.when(level < WIDE, 1).otherwise(SALTS)


def _indexed(spans: DataFrame) -> DataFrame:
    """``spans`` with ``_dy_level`` and ``_dy_at``, a row a piece."""
    return spans.withColumn("_dy_piece", F.explode(pieces(F.col("line_start"), F.col("line_end")))).select("*", F.col("_dy_piece.level").alias("_dy_level"), F.col("_dy_piece.at").alias("_dy_at")).drop("_dy_piece")


def _levels(index: DataFrame) -> list[int]:
    """Levels in use: 64 at most."""
    return sorted(r[0] for r in index.select("_dy_level").distinct().collect())


def _probes(points: DataFrame, line: str, levels: list[int]) -> DataFrame:
    """``points`` once for each of ``levels``, with ``_dy_l``, ``_dy_a`` and ``_dy_salt``."""
    each = points.withColumn("_dy_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    at = F.call_function("shiftright", F.col(line).cast("long"), F.col("_dy_l"))
    return each.withColumn("_dy_a", at).withColumn("_dy_salt", F.pmod(F.xxhash64(line), _salts(F.col("_dy_l"))).cast("int"))


def _met(points: DataFrame, index: DataFrame, file: str, line: str) -> DataFrame:
    """Probes of ``points`` joined to a written ``index`` (``file_path``, ``_dy_level``, ``_dy_at`` and more)."""
    dealt = index.withColumnRenamed("file_path", "_dy_span_file").withColumn("_dy_s", F.explode(F.sequence(F.lit(0), _salts(F.col("_dy_level")) - 1)))
    on = (F.col(file) == F.col("_dy_span_file")) & (F.col("_dy_l") == F.col("_dy_level")) & (F.col("_dy_a") == F.col("_dy_at")) & (F.col("_dy_salt") == F.col("_dy_s"))
    return _probes(points, line, _levels(index)).join(dealt, on).drop("_dy_l", "_dy_a", "_dy_salt", "_dy_s", "_dy_level", "_dy_at", "_dy_span_file")


def contained(points: DataFrame, spans: DataFrame, point_file: str, point_line: str) -> DataFrame:
    """Pairs of a point and a span (``file_path``, ``line_start``, ``line_end``) of its file that holds its line."""
    scratch = Scratch(points.sparkSession, "spans")
    return _met(points, scratch.keep(_indexed(spans), "pieces"), point_file, point_line)


def holding(spans: DataFrame, points: DataFrame, point_file: str, point_line: str) -> DataFrame:
    """The rows of ``spans`` that hold at least one of ``points``, each once; pairs are never made."""
    scratch = Scratch(spans.sparkSession, "holding")
    numbered = scratch.keep(spans.withColumn("_row", F.monotonically_increasing_id()), "spans")
    index = scratch.keep(_indexed(numbered.select("_row", "file_path", "line_start", "line_end")).select("_row", "file_path", "_dy_level", "_dy_at"), "pieces")
    distinct = points.select(F.col(point_file).alias("_pf"), F.col(point_line).alias("_pl")).distinct()
    marked = _probes(distinct, "_pl", _levels(index)).select("_pf", "_dy_l", "_dy_a").distinct()
    hits = index.join(marked, (F.col("file_path") == F.col("_pf")) & (F.col("_dy_level") == F.col("_dy_l")) & (F.col("_dy_at") == F.col("_dy_a")), "left_semi")
    return numbered.join(hits.select("_row").distinct(), "_row", "left_semi").drop("_row")


def _best(points: DataFrame, spans: DataFrame, key: list[str], file: str, line: str, keep: list[str], order: Column) -> DataFrame:
    """The span of the smallest ``order`` around each point: the best of each piece, then the
    best of the pieces around each line that has a point, then those of the points."""
    scratch = Scratch(points.sparkSession, "best")
    one = lambda c: F.min_by(F.struct("_o", "_s"), F.col("_o")).alias(c)
    index = _indexed(spans.where(F.col("file_path").isNotNull())).select("file_path", "_dy_level", "_dy_at", order.alias("_o"), F.struct(*keep).alias("_s"))
    index = scratch.keep(index.groupBy("file_path", "_dy_level", "_dy_at").agg(one("_b")), "pieces")
    given = scratch.keep(points.select(*dict.fromkeys([*key, file, line])).where(F.col(file).isNotNull() & F.col(line).isNotNull()), "points")
    lines = given.groupBy(file, line).agg(F.count(F.lit(1)).alias("n"))
    probed = _met(lines, index, file, line).groupBy(file, line, "n").agg(F.min_by("_b", "_b._o").alias("_b"))
    if set(key) == {file, line}:
        return probed.select(*key, *(F.col(f"_b._s.{c}").alias(c) for c in keep))
    found = join_by_count(given, scratch.keep(probed, "lines"), [file, line])
    best = found.groupBy(*key).agg(F.min_by("_b", "_b._o").alias("_b"))
    return best.select(*key, *(F.col(f"_b._s.{c}").alias(c) for c in keep))


def enclosing_function(points: DataFrame, symbols: DataFrame, key: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """The innermost function or method around each point: largest start, then the smaller end, then name."""
    functions = symbols.where(F.col("kind").isin("function", "method"))
    order = F.struct((-F.col("line_start").cast("long")).alias("a"), F.col("line_end").alias("b"), F.col("name").alias("c"))
    return _best(points, functions, key, file, line, ["name", "line_start", "line_end"], order)


def smallest_symbol(points: DataFrame, symbols: DataFrame, key: list[str], file: str = "file", line: str = "line") -> DataFrame:
    """The symbol of any kind with the fewest lines around each point; ties go to the later start, then name."""
    length = F.col("line_end").cast("long") - F.col("line_start").cast("long")
    order = F.struct(length.alias("a"), (-F.col("line_start").cast("long")).alias("b"), F.col("name").alias("c"))
    return _best(points, symbols, key, file, line, ["name", "kind", "line_start", "line_end"], order)
