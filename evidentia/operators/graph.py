"""Dataflow graph: seeds, sinks, bounded traversal, chains and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import eng8, leaf
from evidentia.operators.dedup import numbered
from evidentia.operators.intervals import holding
from evidentia.operators.reach import MOST_EDGES, Graph, Reach
from evidentia.scratch import Scratch, written

# Lines looked at around a hop; largest file that is read.
LOOKBACK, BEFORE, AFTER = 5, 40, 8
LARGEST_FILE = 4 << 20


def _leaf(text: str) -> str:
    return text.replace(":", ".").rsplit(".", 1)[-1]


def expanded_sinks(sinks: list[str]) -> list[str]:
    """Sinks and their leaf forms, without repeats."""
    return sorted({x for s in sinks for x in (s, _leaf(s)) if x})


def expanded(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """The same for a table of patterns."""
    both = patterns.select(F.explode(F.array(F.col(column), leaf(F.col(column)))).alias(column))
    return both.where(F.col(column) != "").distinct()


def _seeds_of(symbol: Column, source: str) -> Column:
    """The source's text anywhere, or a symbol that ends in its leaf; ASCII case aside."""
    return symbol.ilike(f"%{source}%") | symbol.ilike(f"%:{_leaf(source)}")


def seeds(edges: DataFrame, sources: list[str]) -> DataFrame:
    """Distinct (source, seed): patterns are matched against distinct symbols only."""
    symbols = edges.select(F.col("from_symbol").alias("seed")).distinct()
    hits = F.array_compact(F.array(*(F.when(_seeds_of(F.col("seed"), s), F.lit(s)) for s in sources))) if sources else F.array().cast("array<string>")
    return symbols.select(F.explode(hits).alias("source"), "seed")


def is_sink(symbol: Column, sinks: list[str]) -> Column:
    out = F.lit(False)
    for s in expanded_sinks(sinks):
        out = out | symbol.contains(s)
    return out


def reached(edges: DataFrame, starts: DataFrame, sinks: list[str], most: int = MOST_EDGES, toward_sinks: bool = False) -> Reach:
    """What each (source, seed) reaches; see :class:`evidentia.operators.reach.Reach`."""
    return Reach(Graph(edges, is_sink(F.col("to_symbol"), sinks)), starts, most, toward_sinks)


def traverse(edges: DataFrame, starts: DataFrame, sinks: list[str], most: int = MOST_EDGES) -> DataFrame:
    """Breadth-first reach of each (source, seed), one level a step.

    Returns ``source``, ``seed``, ``symbol``, ``hops``, ``is_sink`` and the edge
    by which the symbol was reached first (``from_symbol``, ``edge_kind``,
    ``file_path``, ``line``; of equal hops the smallest edge). Seeds are not
    tested as sinks, sinks are not left again, and no symbol lies more than
    ``most`` edges away. Where parent edges are not needed, or only those of
    paths to sinks, :func:`reached` is cheaper."""
    return reached(edges, starts, sinks, most).with_parents()


def chains(reached: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """One path for each sink reached: parent edges are followed back from the hits only.

    Returns ``source``, ``seed``, ``sink``, ``hops`` and ``edges``, an array of
    structs from the seed to the sink. Steps back are joins of one plan, as many
    as the longest path needs; a path that has ended takes no part in the next."""
    hop = F.struct("from_symbol", F.col("symbol").alias("to_symbol"), "edge_kind", "file_path", "line")
    parents = reached.select(F.col("source").alias("_s"), F.col("seed").alias("_d"), F.col("symbol").alias("_at"), F.col("from_symbol").alias("_up"), hop.alias("_hop"))
    scratch = Scratch(reached.sparkSession, "chains")
    open_ = reached.where("is_sink").select("source", "seed", F.col("symbol").alias("sink"), "hops", F.col("from_symbol").alias("_next"), F.array(hop).alias("edges"))
    open_ = scratch.keep(open_, "hits")
    longest = open_.agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0]
    done = open_.where("hops = 1")
    open_ = open_.where("hops > 1")
    for step in range(1, min(longest, most)):
        up = open_.join(parents, (F.col("source") == F.col("_s")) & (F.col("seed") == F.col("_d")) & (F.col("_next") == F.col("_at")))
        up = up.select("source", "seed", "sink", "hops", F.col("_up").alias("_next"), F.concat(F.array("_hop"), "edges").alias("edges"))
        open_ = scratch.keep(up, f"step_{step}") if step % 4 == 0 else up
        done, open_ = done.unionByName(open_.where(F.col("hops") == step + 1)), open_.where(F.col("hops") > step + 1)
    return done.drop("_next")


def on_path(edges: Column, guards: list[str]) -> Column:
    """True if a symbol of the path contains a guard."""
    hit = lambda s: _any_contains(s, guards)
    return F.exists(edges, lambda e: hit(e["from_symbol"]) | hit(e["to_symbol"]))


def _any_contains(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def file_lines(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """Numbered lines of the files (``path``, ``text``) that are small enough to read."""
    small = files.where(F.col("text").isNotNull() & (F.octet_length("text") <= largest))
    return small.select(F.col("path").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("_n", "content")).select(
        "file_path", (F.col("_n") + 1).alias("line"), "content"
    )


def guarded_scopes(hops: DataFrame, symbols: DataFrame, lines: DataFrame, guards: list[str]) -> DataFrame:
    """Distinct (``file``, ``line``) of ``hops`` with a guard in scope.

    The scope is the innermost function or method around the line and the five
    lines above it, or else 40 lines before and 8 after. Files that cannot be
    read have no guard. Lines that hold a guard are few, so they are found
    first; a scope asks whether it holds one by its dyadic pieces."""
    from evidentia.operators.intervals import enclosing_function

    hops = hops.select("file", "line").distinct()
    inside = enclosing_function(hops, symbols, ["file", "line"]).select("file", "line", "line_start", "line_end")
    scopes = hops.join(inside, ["file", "line"], "left").select(
        F.col("file").alias("file_path"), F.col("line").alias("hop_line"),
        F.greatest(F.coalesce(F.col("line_start") - LOOKBACK, F.col("line") - BEFORE), F.lit(1)).alias("line_start"),
        F.coalesce(F.col("line_end"), F.col("line") + AFTER).alias("line_end"),
    )
    marked = lines.where(_any_contains(F.col("content"), guards)).select(F.col("file_path").alias("guard_file"), F.col("line").alias("guard_line"))
    return holding(scopes, marked, "guard_file", "guard_line").select(F.col("file_path").alias("file"), F.col("hop_line").alias("line"))


def taint_chains(
    edges: DataFrame, sources: list[str], sinks: list[str], guards: list[str], symbols: DataFrame, lines: DataFrame, engagement_id: str,
    most: int = MOST_EDGES,
) -> DataFrame:
    """Rows of the taint_chains table for one engagement.

    A chain without a guard on its path or in the scope of its first and last
    hop carries the marker ``unguarded``. Ids count chains by seed, sink, hops
    and path. Without guards in the model every chain is unguarded."""
    graph = Graph(edges, is_sink(F.col("to_symbol"), sinks))
    paths = Reach(graph, seeds(graph.rows, sources), most).chains()
    first, last = F.col("edges")[0], F.element_at("edges", -1)
    flat = written(paths.select("*", first["file_path"].alias("source_file"), first["line"].alias("source_line"), last["file_path"].alias("sink_file"), last["line"].alias("sink_line"), on_path(F.col("edges"), guards).alias("_on_path")), "chains")
    ends = flat.select(F.col("source_file").alias("file"), F.col("source_line").alias("line")).unionByName(
        flat.select(F.col("sink_file").alias("file"), F.col("sink_line").alias("line"))
    )
    scopes = guarded_scopes(ends, symbols, lines, guards)
    for side in ("source", "sink"):
        s = scopes.select(F.col("file").alias(f"_{side}_file"), F.col("line").alias(f"_{side}_line"), F.lit(True).alias(f"_{side}"))
        flat = flat.join(s, (F.col(f"{side}_file") == F.col(f"_{side}_file")) & (F.col(f"{side}_line") == F.col(f"_{side}_line")), "left")
    guarded = F.col("_on_path") | F.coalesce("_source", F.lit(False)) | F.coalesce("_sink", F.lit(False))
    hops = F.transform("edges", lambda e: F.struct(
        e["file_path"].alias("file_path"), e["line"].alias("line"),
        F.concat(e["edge_kind"], F.lit(": "), e["from_symbol"], F.lit(" -> "), e["to_symbol"]).alias("propagation_reason"),
    ))
    rows = flat.select(
        F.lit(engagement_id).alias("engagement_id"), "source", "seed", "sink", "hops", "source_file", "source_line", "sink_file", "sink_line",
        hops.alias("chain"), F.when(guarded, F.array().cast("array<string>")).otherwise(F.array(F.lit("unguarded"))).alias("sanitizers_seen"),
    )
    order = ["seed", "sink", "hops", F.to_json("chain"), "source"]
    ids = numbered(rows, F.concat(F.lit("TC-"), eng8(F.col("engagement_id"))), order, ["engagement_id"])
    return ids.drop("source", "seed", "sink", "hops")
