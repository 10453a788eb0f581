"""Bounded reach over a dataflow graph, level by level, on written tables.

Edges are written once, in buckets of the symbol that they leave. A level joins
the frontier to them, so only the frontier moves; edges are neither shuffled nor
sorted again. Symbols with many edges (hubs) have theirs dealt to blocks, and the
frontier's row of a hub goes to each block, so that no task holds a whole hub.

Seeds are numbered and travel as bits: a row of the frontier is a symbol, a
block of 64 seeds and the bits of those that are there, joined by ``bit_or``. What
is new at a symbol is told by the same aggregate that unites the candidates,
as the rows reached before take part in it. Parent edges are not carried: they
are worked out backwards, for the rows that are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.scratch import Scratch

# Fixed value: edges of a chain at most.
MOST_EDGES = 12
#: Edges of one symbol in a block; edges of a bucket; rows that a frontier has at most to be hashed in each task's memory at once.
HUB, EDGES_A_BUCKET, SALTS = 100_000, 4_000_000, 16
BITS = 64

EDGE = ["from_symbol", "to_symbol", "edge_kind", "file_path", "line"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _same(columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{prefix}{c}") for c in columns))


def exploded(rows: DataFrame) -> DataFrame:
    """A row for each of the ``bits``, with its place as ``bit``."""
    each = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return rows.withColumn("bit", F.explode(each)).drop("bits")


def named(rows: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """``source`` and ``seed`` for rows of ``by``, ``block`` and ``bit``. One seed may have most of the rows, so
    seeds, which are few, are there once for each salt."""
    salt = F.pmod(F.xxhash64("symbol"), F.lit(SALTS)).cast("int")
    known = seeds.select(*(F.col(c).alias(f"_n_{c}") for c in (*by, "block", "bit")), "source", "seed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_n__salt"))
    return rows.withColumn("_salt", salt).join(known, _same([*by, "block", "bit", "_salt"], "_n_")).drop("_salt", *(c for c in known.columns if c.startswith("_n_")))


class Graph:
    """Edges laid out for traversal.

    ``edges`` has ``from_symbol``, ``to_symbol``, ``edge_kind``, ``file_path``, ``line`` and the columns ``by`` (such
    as an engagement), within which symbols are told apart. ``sinks`` is a condition on
    a column of symbols, or a table of ``by`` and ``symbol``. Edges with a null symbol lead nowhere."""

    def __init__(self, edges: DataFrame, sinks: Column | DataFrame, by: list[str] | None = None, hub: int = HUB, bucket: int = EDGES_A_BUCKET) -> None:
        self.spark, self.by, self.hub, self.bucket = edges.sparkSession, by or [], hub, bucket
        self.scratch = Scratch(self.spark, "reach")
        steps = edges.select(*self.by, *EDGE).where("from_symbol IS NOT NULL AND to_symbol IS NOT NULL")
        if isinstance(sinks, Column):
            steps = steps.withColumn("to_sink", F.coalesce(sinks, F.lit(False)))
        else:
            known = sinks.select(*(F.col(c).alias(f"_s_{c}") for c in self.by), F.col("symbol").alias("_s_symbol")).distinct()
            on = (F.col("to_symbol") == F.col("_s_symbol")) & (_same(self.by, "_s_") if self.by else F.lit(True))
            steps = steps.join(known, on, "left").withColumn("to_sink", F.col("_s_symbol").isNotNull()).drop(*known.columns)
        self.parts, told = int(self.spark.conf.get("spark.sql.shuffle.partitions")), Observation()
        self.rows = self.scratch.keep(steps.observe(told, F.count(F.lit(1)).alias("n")), "edges")
        self.n = told.get["n"]
        self._laid: dict[str, tuple[DataFrame, DataFrame | None]] = {}

    def laid(self, end: str) -> tuple[DataFrame, DataFrame | None]:
        """Edges in buckets of one end, with ``_part``, and the hubs there (or None). Edges of
        one bucket are read as they were written: to deal them out would cost more than it saves."""
        if end not in self._laid and self.n <= self.bucket:
            self._laid[end] = self.rows.withColumn("_part", F.lit(0)), None
        if end not in self._laid:
            keys, other = [*self.by, end], {"from_symbol": "to_symbol", "to_symbol": "from_symbol"}[end]
            seen = Observation()
            degrees = self.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.max("_n").alias("most"))
            hubs = degrees.where(F.col("_n") > self.hub).select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.ceil(F.col("_n") / self.hub).cast("int").alias("_parts"))
            hubs = self.scratch.keep(hubs, f"hubs_{end}")
            dealt = self.rows.withColumn("_part", F.lit(0))
            if (seen.get["most"] or 0) > self.hub:
                part = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")
                dealt = self.rows.join(hubs, _same(keys, "_h_"), "left").select(*self.rows.columns, part.alias("_part"))
            else:
                hubs = None
            buckets = max(self.parts, -(-self.n // self.bucket))
            self._laid[end] = self.scratch.keep_bucketed(dealt, f"by_{end}", [*keys, "_part"], buckets), hubs
        return self._laid[end]

    def joined(self, frontier: DataFrame, end: str, rows: int | None = None) -> DataFrame:
        """``frontier`` (with ``by`` and ``_at``, a symbol) and the edges whose ``end`` is there.

        Only the frontier moves. Small ones (by the size of their files) are broadcast by
        Spark; larger ones are hashed by bucket, so that edges pass unsorted."""
        edges, hubs = self.laid(end)
        keys = [*self.by, end]
        f = frontier.select(*(F.col(c).alias(f"_f_{c}") for c in self.by), F.col("_at").alias(f"_f_{end}"), *(c for c in frontier.columns if c not in (*self.by, "_at")))
        if hubs is None:
            f = f.withColumn("_f__part", F.lit(0))
        else:
            f = f.join(hubs, reduce(lambda a, b: a & b, (F.col(f"_f_{k}") == F.col(f"_h_{k}") for k in keys)), "left")
            f = f.withColumn("_f__part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", *(f"_h_{k}" for k in keys))
        if self.n > self.bucket and (rows is None or rows > self.hub):
            f = f.hint("shuffle_hash")
        return edges.join(f, _same([*keys, "_part"], "_f_")).drop("_part", *(f"_f_{k}" for k in (*keys, "_part")))

    def to_sinks(self, most: int = MOST_EDGES) -> DataFrame:
        """``by``, ``symbol``, ``dist``: edges to the nearest sink, for symbols that reach one within ``most``.
        Sinks are not left, so paths lead to the first sink only; a sink is at 0."""
        key, scratch = [*self.by, "symbol"], Scratch(self.spark, "distances")
        zero = self.rows.where("to_sink").select(*self.by, F.col("to_symbol").alias("symbol")).distinct().withColumn("dist", F.lit(0))
        found = [scratch.keep(zero, "dist_0")]
        for level in range(1, most + 1):
            at = found[-1].select(*self.by, F.col("symbol").alias("_at"))
            before = self.joined(at, "to_symbol").select(*self.by, F.col("from_symbol").alias("symbol"), F.lit(level).alias("dist"))
            told = Observation()
            new = before.unionByName(_union(found)).groupBy(*key).agg(F.min("dist").alias("dist")).where(F.col("dist") == level)
            found.append(scratch.keep(new.observe(told, F.count(F.lit(1)).alias("n")), f"dist_{level}"))
            if not told.get["n"]:
                break
        return _union(found)


class Reach:
    """What seeds reach. ``levels[h]`` has ``by``, ``block``, ``symbol``, ``bits`` and ``is_sink``: the seeds of a block that reach
    a symbol by ``h`` edges and not by fewer. ``seeds`` has ``by``, ``block``, ``bit``, ``source``, ``seed``."""

    def __init__(self, graph: Graph, starts: DataFrame, most: int = MOST_EDGES, toward_sinks: bool = False) -> None:
        """``starts`` has ``by``, ``source`` and ``seed``; rows that repeat count once. Seeds are not tested as
        sinks, sinks are not left again, no symbol lies more than ``most`` edges away.
        With ``toward_sinks`` symbols that cannot reach a sink in the edges that are left
        are dropped on the way: sinks and paths to them are the same, other rows are
        missing. That pays where few symbols lead to sinks."""
        self.graph, self.by, self.most = graph, graph.by, most
        self.told: list[dict] = []  # rows of each level: candidates after the join, new, open
        self.scratch = Scratch(graph.spark, "levels")
        keep = self.scratch.keep
        number = F.monotonically_increasing_id()
        named = keep(starts.select(*self.by, "source", "seed").distinct().withColumn("_id", number), "starts")
        self.seeds = named.select(*self.by, F.floor(F.col("_id") / BITS).cast("long").alias("block"), (F.col("_id") % BITS).cast("int").alias("bit"), "source", "seed")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
        zero = self.seeds.groupBy(*self.by, "block", F.col("seed").alias("symbol")).agg(F.bit_or(mask).alias("bits"))
        key = [*self.by, "block", "symbol"]
        self.levels = [keep(zero.select(*key, "bits", F.lit(False).alias("is_sink")), "levels/hops=0")]
        self._schema = T.StructType([*self.levels[0].schema, T.StructField("hops", T.IntegerType())])
        labels = graph.to_sinks(most) if toward_sinks else None
        rows = None
        for level in range(1, most + 1):
            frontier = self.levels[-1].where(~F.col("is_sink")).select(*self.by, "block", F.col("symbol").alias("_at"), "bits")
            met = graph.joined(frontier, "from_symbol", rows)
            near = met.select(*self.by, "block", F.col("to_symbol").alias("symbol"), "bits", F.lit(0).cast("long").alias("old"), F.col("to_sink").alias("is_sink"))
            seen = self._all().select(*key, F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old"), F.lit(False).alias("is_sink"))
            both = near.unionByName(seen).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"), F.bool_or("is_sink").alias("is_sink"))
            new = both.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("old"))).where("bits != 0").drop("old")
            if labels is not None:
                left = labels.where(F.col("dist") <= most - level).select(*(F.col(c).alias(f"_d_{c}") for c in self.by), F.col("symbol").alias("_d_symbol"))
                new = new.join(left, _same([*self.by, "symbol"], "_d_"), "left_semi")
            told = Observation()
            new = new.observe(told, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_sink")).alias("open"))
            self.levels.append(keep(new.select(*key, "bits", "is_sink"), f"levels/hops={level}"))
            self.told.append(told.get)
            rows = told.get["open"]
            if not rows:
                break

    def _exploded(self, rows: DataFrame) -> DataFrame:
        return exploded(rows)

    def _named(self, rows: DataFrame) -> DataFrame:
        return named(rows, self.seeds, self.by)

    def _all(self) -> DataFrame:
        """All levels so far, in one scan, with ``hops``."""
        return self.graph.spark.read.schema(self._schema).parquet(f"{self.scratch.root}/levels")

    def _reached(self) -> DataFrame:
        return self._all().where("hops > 0")

    def rows(self) -> DataFrame:
        """``by``, ``source``, ``seed``, ``symbol``, ``hops``, ``is_sink``: a row for each seed and symbol."""
        return self._named(self._exploded(self._reached())).select(*self.by, "source", "seed", "symbol", "hops", "is_sink")

    def sinks(self) -> DataFrame:
        """Those of :meth:`rows` that are sinks."""
        return self._named(self._exploded(self._reached().where("is_sink"))).select(*self.by, "source", "seed", F.col("symbol").alias("sink"), "hops")

    def parents(self, level: int, wanted: DataFrame, rows: int | None = None) -> DataFrame:
        """For rows of a level (``by``, ``block``, ``symbol``, ``bits``): ``by``, ``block``, ``bit``, ``symbol`` and ``e``, the smallest edge by
        which the seed came there. Seeds stay bits until edge and parent have met."""
        at = wanted.select(*self.by, "block", F.col("symbol").alias("_at"), "bits")
        met = self.graph.joined(at, "to_symbol", rows)
        met = met.select(*self.by, "block", F.col("to_symbol").alias("symbol"), "bits", F.struct("from_symbol", "line", "edge_kind", "file_path").alias("e"), F.col("from_symbol").alias("_up"))
        before = self.levels[level - 1].where(~F.col("is_sink")).select(*(F.col(c).alias(f"_b_{c}") for c in (*self.by, "block")), F.col("symbol").alias("_b__up"), F.col("bits").alias("_b_bits"))
        both = met.join(before, _same([*self.by, "block", "_up"], "_b_")).withColumn("bits", F.col("bits").bitwiseAND(F.col("_b_bits"))).where("bits != 0")
        return self._exploded(both.select(*self.by, "block", "symbol", "bits", "e")).groupBy(*self.by, "block", "bit", "symbol").agg(F.min("e").alias("e"))

    def with_parents(self) -> DataFrame:
        """:meth:`rows`, with the edge by which each was reached first."""
        out = []
        for h, table in enumerate(self.levels):
            if h:
                told = self._exploded(table.select(*self.by, "block", "symbol", "bits", "is_sink"))
                up = self.parents(h, table, self.told[h - 1]["n"]).select(*(F.col(c).alias(f"_u_{c}") for c in (*self.by, "block", "bit", "symbol")), "e")
                out.append(told.join(up, _same([*self.by, "block", "bit", "symbol"], "_u_")).select(*self.by, "block", "bit", "symbol", "is_sink", "e", F.lit(h).alias("hops")))
        named = self._named(_union(out))
        return named.select(*self.by, "source", "seed", "symbol", "hops", "is_sink", "e.from_symbol", "e.edge_kind", "e.file_path", "e.line")

    def chains(self) -> DataFrame:
        """One path for each seed and sink: ``by``, ``source``, ``seed``, ``sink``, ``hops`` and ``edges``, from the seed on. Of equally
        short paths the one with the smallest edges, from the sink backwards."""
        keep, id_ = Scratch(self.graph.spark, "chains").keep, [*self.by, "block", "bit", "sink", "hops"]
        none = "array<struct<from_symbol:string,to_symbol:string,edge_kind:string,file_path:string,line:int>>"
        open_ = None
        for h in range(len(self.levels) - 1, 0, -1):
            hits = self._exploded(self.levels[h].where("is_sink")).select(*self.by, "block", "bit", F.col("symbol").alias("sink"), F.lit(h).alias("hops"), "symbol", F.array().cast(none).alias("edges"))
            open_ = hits if open_ is None else open_.unionByName(hits)
            if h % 4 == 0:
                open_ = keep(open_, f"open_{h}")
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
            wanted = open_.groupBy(*self.by, "block", "symbol").agg(F.bit_or(mask).alias("bits"))
            up = self.parents(h, wanted).select(*(F.col(c).alias(f"_u_{c}") for c in (*self.by, "block", "bit", "symbol")), "e")
            hop = F.struct("e.from_symbol", F.col("symbol").alias("to_symbol"), "e.edge_kind", "e.file_path", "e.line")
            met = open_.join(up, _same([*self.by, "block", "bit", "symbol"], "_u_"))
            open_ = met.select(*id_, F.col("e.from_symbol").alias("symbol"), F.concat(F.array(hop), "edges").alias("edges"))
        if open_ is None:
            open_ = self._exploded(self.levels[0].limit(0)).select(*self.by, "block", "bit", F.col("symbol").alias("sink"), F.lit(0).alias("hops"), "symbol", F.array().cast(none).alias("edges"))
        return self._named(open_).select(*self.by, "source", "seed", "sink", "hops", "edges")
