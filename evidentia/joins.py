"""Joins that keep hot keys apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_count(rows: DataFrame, keyed: DataFrame, key: list[str], total: int | None = None, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row a key and the
    number of ``rows`` that have it, ``n``.

    A key with more than ``1 / share`` of the ``total`` rows is joined by
    broadcast: there are fewer than ``share`` of them, whatever the input. Its
    rows then take the second join with a salt that matches nothing, so that
    no task of it gets a hot key. Keys are not null. ``keyed`` is read twice,
    three times where ``total`` is not given, so it should be a written table."""
    if total is None:
        total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    values = [c for c in keyed.columns if c not in (*key, "n")]
    hot = F.col("n") * share > total
    heavy = keyed.where(hot).select(*(F.col(k).alias(f"_h_{k}") for k in key), F.struct(*values).alias("_heavy"))
    light = keyed.where(~hot).select(*(F.col(k).alias(f"_l_{k}") for k in key), F.struct(*values).alias("_light"), F.lit(0).cast("long").alias("_l_salt"))
    same = lambda p: reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{p}{k}") for k in key))
    first = rows.join(F.broadcast(heavy), same("_h_"), "left")  # fewer than ``share`` rows
    salted = first.withColumn("_salt", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    both = salted.join(light, same("_l_") & (F.col("_salt") == F.col("_l_salt")), "left")
    if how == "inner":
        both = both.where(F.col("_heavy").isNotNull() | F.col("_light").isNotNull())
    return both.select(*rows.columns, *(F.coalesce(f"_heavy.{v}", f"_light.{v}").alias(v) for v in values))
