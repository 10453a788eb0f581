"""Connected components of a link table, with tables instead of driver memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_by_count


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours.
    A star's centre is a hot key: it is joined apart from the others."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_by_count(both, least, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # after a large star, u has few smaller neighbours: its own component's smallest and ties of this round
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def smallest_reachable(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Columns ``node``, ``root``: each linked node and the smallest node it reaches.

    ``edges`` has columns ``u``, ``v`` of one orderable type; direction,
    repeats and self-links don't matter. Rounds of large-star and small-star
    shrink every component to a star around its smallest node; the rounds grow
    with the logarithm of the longest path. Each round is a written table, so
    the driver sees two numbers a round and a lost executor costs one round.
    An empty table gives an empty table.
    """
    now = scratch.keep(edges.where("u <> v").select("u", "v").distinct(), "links_0")
    state = _state(now)
    for turn in range(1, most_rounds + 1):
        if not state[0]:
            break
        new = scratch.keep(_small_star(_large_star(now, state[0]).distinct()).where("u <> v").distinct(), f"links_{turn}")
        scratch.free(f"links_{turn - 1}")
        now, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
