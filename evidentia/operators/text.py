"""Source text: lines, ranges, symbol bodies, imports, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import cut_bytes
from evidentia.operators.intervals import smallest_symbol

CHUNK_BYTES = 4096
IMPORTS = ("import ", "from ")


def lines_of(text: Column) -> Column:
    """Lines of a text; a newline at the end starts no further line."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def line_range(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included), as ``n: line`` joined by newlines."""
    numbered = F.transform(lines_of(text), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    low, high = F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last
    shown = F.filter(numbered, lambda s: (s["n"] >= low) & (s["n"] <= high))
    return F.array_join(F.transform(shown, lambda s: F.concat(s["n"].cast("string"), F.lit(": "), s["x"])), "\n")


def body(text: Column, first: Column, last: Column) -> Column:
    """The lines of a symbol, clamped to the text."""
    lines = lines_of(text)
    low = F.greatest(first, F.lit(1))
    high = F.least(last, F.size(lines))
    return F.when(high >= low, F.array_join(F.slice(lines, low, high - low + 1), "\n")).otherwise("")


def import_lines(text: Column, prefixes: tuple[str, ...] = IMPORTS) -> Column:
    """Lines that begin with an import after leading white space, trimmed."""
    def begins(line: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.ltrim(line).startswith(p)
        return out

    return F.transform(F.filter(lines_of(text), begins), lambda v: F.trim(v))


def symbols_named(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def context(points: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Imports, smallest symbol and its body around each point (``file``, ``line``)."""
    best = smallest_symbol(points, symbols, ["file", "line"])
    both = points.select("file", "line").distinct().join(best, ["file", "line"], "left").join(files.select(F.col("path").alias("file"), "text"), "file", "left")
    return both.select("file", "line", "name", "kind", "line_start", "line_end", import_lines(F.col("text")).alias("imports"), body(F.col("text"), F.col("line_start"), F.col("line_end")).alias("body"))


def chunks(files: DataFrame, symbols: DataFrame, by_symbol: tuple[str, ...] = ("python",), most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks for indexing: symbols of languages in ``by_symbol`` (classes and
    their methods both), whole files of others and files without symbols.

    Blank texts give none. Ids are ``path:first-last``; texts are cut to
    ``most_bytes`` at a code point."""
    spans = symbols.where(F.col("language").isin(*by_symbol)).select(F.col("file_path").alias("path"), "line_start", "line_end", F.col("name").alias("symbol_name"))
    own = files.join(spans, "path", "left")
    whole = F.col("line_start").isNull()
    n = F.size(lines_of(F.col("text")))
    out = own.select(
        "path", F.when(whole, 1).otherwise(F.col("line_start")).alias("line_start"), F.when(whole, n).otherwise(F.col("line_end")).alias("line_end"), "symbol_name", "language",
        cut_bytes(F.when(whole, F.col("text")).otherwise(body(F.col("text"), F.col("line_start"), F.col("line_end"))), most_bytes).alias("text"),
    ).where(F.col("text").rlike(r"\S"))
    return out.select(F.concat("path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("id"), F.col("path").alias("file_path"), "line_start", "line_end", "symbol_name", "language", "text")
