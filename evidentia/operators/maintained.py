"""Reach that is kept as edges come in, by semi-naive maintenance.

What was reached is a log of rows (block of seeds, symbol, bits, hops), dealt to
buckets of the symbol. New edges meet the logged rows of the symbols that they
leave; what they reach, by fewer hops than before or for the first time, is
the delta frontier, which then goes on over all edges, level by level. Only
such rows are written: the hops of a seed at a symbol are the fewest that the
log has, so nothing is rewritten. Edges and log are read in the buckets that
a step touches.

An insertion is a version: its rows count once its commit is written, so what a
lost run has left is passed over and removed by the next. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.reach import BITS, MOST_EDGES, _same, exploded, named
from evidentia.scratch import Scratch, _delete
from evidentia.sources.dealt import BUCKETS, bit, bucket_of, put, told_of, touched, touching, within


class MaintainedReach:
    """A stored reach under ``root``, within columns ``by`` (strings).

    ``seeds_of`` gives ``by``, ``source`` and ``seed`` of a table of edges; ``sinks`` says whether a symbol is one. Both must
    stay the same for all insertions: another model is another table. The rules
    are those of :class:`evidentia.operators.reach.Reach`: seeds are not tested as sinks, sinks
    are not left again, no symbol lies more than ``most`` edges away. Edges with a null
    symbol lead nowhere; edges that are there already, and an empty table, change
    nothing. Other columns of edges are ignored."""

    def __init__(self, spark: SparkSession, root: str, seeds_of: Callable[[DataFrame], DataFrame], sinks: Callable[[Column], Column], by: list[str] | None = None, most: int = MOST_EDGES, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.seeds_of, self.sinks, self.by, self.most, self.buckets = spark, root.rstrip("/"), seeds_of, sinks, by or [], most, buckets
        keys = "".join(f"{c} string, " for c in self.by)
        self.schemas = {
            "edges": f"{keys}from_symbol string, to_symbol string, to_sink boolean, version int, bucket int",
            "seeds": f"{keys}block long, bit int, source string, seed string, version int",
            "levels": f"{keys}block long, symbol string, bits long, hops int, is_sink boolean, version int, bucket int",
        }

    def version(self) -> int:
        """Insertions that are complete."""
        rows = self._table("commits", "n long, version int")
        return rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table, of one version only if given; empty if it was never written."""
        at = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).option("basePath", at).parquet(at if version is None else f"{at}/version={version}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """``edges``, ``seeds`` or ``levels`` as of a version, by default the last complete one."""
        return self._table(name, self.schemas[name]).where(F.col("version") <= (self.version() if version is None else version))

    def _dealt(self, rows: DataFrame, symbol: str) -> DataFrame:
        return rows.withColumn("bucket", bucket_of([*self.by, symbol], self.buckets))

    def insert(self, edges: DataFrame) -> dict[str, int]:
        """Add edges. Returns the numbers of new ``edges`` and ``seeds``, and of ``rows`` of the log that were written."""
        done = self.version()
        here, key, scratch = done + 1, [*self.by, "block", "symbol"], Scratch(self.spark, "maintained")
        for name in self.schemas:
            _delete(self.spark, f"{self.root}/{name}/version={here}")
        meets = lambda n: touching("bucket", self.buckets) + n
        count = F.count(F.lit(1)).alias("n")

        of = [F.col(c).cast("string").alias(c) for c in (*self.by, "from_symbol", "to_symbol")]
        steps = edges.select(*of).where("from_symbol IS NOT NULL AND to_symbol IS NOT NULL").distinct()
        steps = scratch.keep(self._dealt(steps, "from_symbol"), "steps")
        old = within(self.read("edges", done), touched(steps.agg(*meets([])).first().asDict())).select(*(F.col(c).alias(f"_o_{c}") for c in (*self.by, "from_symbol", "to_symbol", "bucket")))
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*self.by, "from_symbol", "to_symbol", "bucket")))
        told = Observation()
        fresh = steps.join(old, on, "left_anti").withColumn("to_sink", F.coalesce(self.sinks(F.col("to_symbol")), F.lit(False)))
        put(fresh.observe(told, *meets([count])), f"{self.root}/edges/version={here}")
        new_edges, left = told_of(told).get("n", 0), touched(told_of(told))
        if not new_edges:
            scratch.close()
            return {"edges": 0, "seeds": 0, "rows": 0}
        fresh = self._table("edges", self.schemas["edges"], here)

        new_seeds = self._new_seeds(fresh, done, here, scratch)
        mask = bit(F.col("bit"))
        zero = new_seeds.groupBy(*self.by, "block", F.col("seed").alias("symbol")).agg(F.bit_or(mask).alias("bits")).withColumn("is_sink", F.lit(False))
        frontier = self._log(zero, here, 0)
        seeds = new_seeds.count()

        # what the logged rows reach by new edges, whatever their hops
        f = fresh.select(*_leaving(self.by), "to_symbol", "to_sink")
        logged = within(self.read("levels", done), left).where(~F.col("is_sink") & (F.col("hops") < self.most))
        on_edge = _same([*self.by, "symbol", "bucket"], "_e_")
        near = logged.join(f, on_edge).select(*self.by, "block", F.col("to_symbol").alias("symbol"), "bits", F.col("to_sink").alias("is_sink"), (F.col("hops") + 1).alias("hops"))
        told = Observation()
        near = near.groupBy(*key, "hops").agg(F.bit_or("bits").alias("bits"), F.bool_or("is_sink").alias("is_sink"))
        near = scratch.keep(near.observe(told, F.bit_or(bit(F.col("hops"))).alias("levels")), "near")
        wait, rows = told_of(told).get("levels") or 0, frontier["n"]

        for h in range(1, self.most + 1):
            parts = []
            if frontier["open"]:
                at = self._table("levels", self.schemas["levels"], here).where((F.col("hops") == h - 1) & ~F.col("is_sink"))
                along = within(self.read("edges", here), frontier["touched"]).select(*_leaving(self.by), "to_symbol", "to_sink")
                met = at.join(along, on_edge)
                parts.append(met.select(*self.by, "block", F.col("to_symbol").alias("symbol"), "bits", F.col("to_sink").alias("is_sink")))
            if wait >> h & 1:
                parts.append(near.where(F.col("hops") == h).select(*key, "bits", "is_sink"))
            if not parts:
                frontier = {"n": 0, "open": 0, "touched": []}
                continue
            told = Observation()
            met = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bool_or("is_sink").alias("is_sink"))
            met = scratch.keep(self._dealt(met, "symbol").observe(told, *meets([])), f"met_{h}")
            before = within(self.read("levels", here), touched(told_of(told))).where(F.col("hops") <= h)
            asked = met.select(*(F.col(c).alias(f"_k_{c}") for c in (*key, "bucket")))
            before = before.join(asked, _same([*key, "bucket"], "_k_"), "left_semi").select(*key, F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old"), F.lit(False).alias("is_sink"))
            both = met.select(*key, "bits", F.lit(0).cast("long").alias("old"), "is_sink").unionByName(before)
            both = both.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"), F.bool_or("is_sink").alias("is_sink"))
            new = both.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("old"))).where("bits != 0").drop("old")
            frontier = self._log(new, here, h)
            rows += frontier["n"]
        self.spark.range(1).select(F.col("id").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/version={here}")
        scratch.close()
        return {"edges": new_edges, "seeds": seeds, "rows": rows}

    def _new_seeds(self, fresh: DataFrame, done: int, here: int, scratch: Scratch) -> DataFrame:
        """Seeds that only the new edges have, numbered behind those of before."""
        old, cols = self.read("seeds", done), [*self.by, "source", "seed"]
        first = old.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
        told = self.seeds_of(fresh).select(*cols).distinct()
        on = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cols))
        new = scratch.keep(told.alias("n").join(old.alias("o"), on, "left_anti").withColumn("_id", F.monotonically_increasing_id()), "seeds")
        block = (F.floor(F.col("_id") / BITS) + first).cast("long")
        new.select(*self.by, block.alias("block"), (F.col("_id") % BITS).cast("int").alias("bit"), "source", "seed").write.parquet(f"{self.root}/seeds/version={here}")
        return self._table("seeds", self.schemas["seeds"], here)

    def _log(self, rows: DataFrame, version: int, hops: int) -> dict:
        """Write rows of a level; what the next level has to know of them."""
        told = Observation()
        dealt = self._dealt(rows.withColumn("hops", F.lit(hops)), "symbol").observe(told, *touching("bucket", self.buckets), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_sink")).alias("open"))
        put(dealt, f"{self.root}/levels/version={version}")
        seen = told_of(told)
        return {"n": seen.get("n", 0), "open": seen.get("open", 0), "touched": touched(seen)}

    def rows(self, version: int | None = None) -> DataFrame:
        """``by``, ``source``, ``seed``, ``symbol``, ``hops``, ``is_sink``: a row for each seed and symbol, by the fewest hops."""
        version = self.version() if version is None else version
        each = exploded(self.read("levels", version).select(*self.by, "block", "symbol", "bits", "hops", "is_sink"))
        best = each.groupBy(*self.by, "block", "bit", "symbol").agg(F.min(F.struct("hops", "is_sink")).alias("m")).select(*self.by, "block", "bit", "symbol", "m.*").where("hops > 0")
        return named(best, self.read("seeds", version).drop("version"), self.by).select(*self.by, "source", "seed", "symbol", "hops", "is_sink")


def _leaving(by: list[str]) -> list[Column]:
    """Columns of edges under the names that a join with the frontier uses."""
    return [*(F.col(c).alias(f"_e_{c}") for c in (*by, "bucket")), F.col("from_symbol").alias("_e_symbol")]
