"""Extraction of symbols, edges and routes from source files, one pass over all languages."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.dedup import first_of
from evidentia.operators.extract import brace_source, python_source

FACTS = "tag string, file_path string, language string, ordinal int, kind string, name string, line_start int, line_end int, from_symbol string, to_symbol string, method string, path string, framework string"
Extractor = Callable[[str, str], tuple[list, list, list]]

#: Language -> extractor of (symbols, edges, routes); others can be added.
EXTRACTORS: dict[str, Extractor] = {"python": python_source.extract}
for _language in brace_source.LANGUAGES:
    EXTRACTORS[_language] = lambda file, text, language=_language: (*brace_source.extract(file, text, language), [])

#: What :func:`facts` calls in their place for symbols alone, as long as they are not replaced.
_SYMBOLS: dict[Extractor, Extractor] = {EXTRACTORS["python"]: lambda file, text: (python_source.symbols(text), [], [])}
for _language in brace_source.LANGUAGES:
    _SYMBOLS[EXTRACTORS[_language]] = lambda file, text, language=_language: (brace_source.symbols(text, language), [], [])

_TYPES = {"string": pa.string(), "int": pa.int32()}
_COLUMNS = {name: _TYPES[kind] for name, kind in (c.split() for c in FACTS.split(", "))}


def facts(files: DataFrame, symbols_only: bool = False) -> DataFrame:
    """Tagged rows (symbol, edge, route) of source files (``path``, ``language``, ``text``).

    Text goes to Python once, in Arrow batches; what is extracted carries the
    ordinal of its place in the file, so later choices do not depend on the run.
    With ``symbols_only`` statements and expressions are not read, and there are
    only rows of symbols and errors. A file that an extractor fails on gives one row, tagged ``error``, with what
    was wrong as ``name``."""
    extractors = {language: _SYMBOLS.get(extract, extract) if symbols_only else extract for language, extract in EXTRACTORS.items()}

    def read(batches):
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text"))):
                try:
                    symbols, edges, routes = extractors[language](path, text or "")
                except Exception as e:  # source is not ours: any file may hold anything
                    symbols = edges = routes = ()
                    rows.append(("error", path, language, 0, type(e).__name__, str(e)[:200], None, None, None, None, None, None, None))
                for n, (kind, name, first, last) in enumerate(symbols):
                    rows.append(("symbol", path, language, n, kind, name, first, last, None, None, None, None, None))
                for n, (source, target, kind, line) in enumerate(() if symbols_only else edges):
                    rows.append(("edge", path, language, n, kind, None, line, line, source, target, None, None, None))
                for n, (method, route, handler, framework, line) in enumerate(() if symbols_only else routes):
                    rows.append(("route", path, language, n, None, handler, line, line, None, None, method, route, framework))
            columns = zip(*rows) if rows else ((),) * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _COLUMNS.values())], names=list(_COLUMNS))

    known = files.where(F.col("language").isin(*extractors)).select("path", "language", "text")
    return known.mapInArrow(read, FACTS)


def errors(found: DataFrame, engagement_id: str) -> DataFrame:
    """Files that could not be read, and why."""
    rows = found.where("tag = 'error'")
    return rows.select(F.lit(engagement_id).alias("engagement_id"), "file_path", "language", F.col("kind").alias("error"), F.col("name").alias("message"))


def symbols(found: DataFrame, engagement_id: str) -> DataFrame:
    rows = found.where("tag = 'symbol'")
    return rows.select(F.lit(engagement_id).alias("engagement_id"), "file_path", "line_start", "line_end", "kind", "name", "language")


def edges(found: DataFrame, engagement_id: str) -> DataFrame:
    """Edges without repeats: of one key the first kind in the file stays."""
    rows = found.where("tag = 'edge'").select(F.lit(engagement_id).alias("engagement_id"), "from_symbol", "to_symbol", F.col("kind").alias("edge_kind"), "file_path", F.col("line_start").alias("line"), "ordinal")
    return first_of(rows, ["engagement_id", "from_symbol", "to_symbol", "line"], ["file_path", "ordinal"]).drop("ordinal")


def routes(found: DataFrame, engagement_id: str) -> DataFrame:
    rows = found.where("tag = 'route'")
    return rows.select(F.lit(engagement_id).alias("engagement_id"), "method", "path", F.col("name").alias("handler_symbol"), "framework", "file_path", F.col("line_start").alias("line"))
