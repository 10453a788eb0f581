"""First-wins dedup, insert-or-ignore and id minting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.scalars import minted_id
from evidentia.numbering import number_in_order
from evidentia.scratch import Scratch


def first_of(df: DataFrame, key: list[Column | str], order: list[Column | str], keep_rest: bool = False) -> DataFrame:
    """The first row of each key in ``order``; with ``keep_rest`` all rows and a
    column ``is_first``. A rank of 1 is computed before the shuffle, too
    (Spark pushes it down as a group limit), so a hot key moves few rows."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    if keep_rest:
        return ranked.withColumn("is_first", F.col("_n") == 1).drop("_n")
    return ranked.where("_n = 1").drop("_n")


def discriminator() -> Column:
    """What tells findings of one line apart: the rule where there is no line, else the CWE, or the rule without one."""
    return F.when(F.col("line_start") == 0, F.col("rule_id")).otherwise(F.coalesce("cwe", "rule_id"))


def cross_tool_dedup(raw: DataFrame, order: list[str]) -> DataFrame:
    """One finding for each (file, line, discriminator): the first in job order, then place in the tool's output."""
    return first_of(raw, ["file_path", "line_start", discriminator()], order)


def with_minted_ids(raw: DataFrame, tool: str = "tool", ordinal: str = "ordinal") -> DataFrame:
    """``id`` as F-<tool>-NNNN from the raw ordinal, so that dropped rows leave gaps."""
    return raw.withColumn("id", minted_id(F.concat(F.lit("F-"), F.col(tool)), F.col(ordinal)))


def numbered(df: DataFrame, prefix: Column, order: list[Column | str], by: list[str], name: str = "id") -> DataFrame:
    """Ids minted in ``order`` within each ``by``, from 1. An engagement may have most of
    the rows, so numbers are given by ranges of the order, not by one task."""
    scratch = Scratch(df.sparkSession, "numbered")
    keys = [f"_o{i}" for i in range(len(order))]
    sorted_ = df.select("*", *((F.col(o) if isinstance(o, str) else o).alias(k) for k, o in zip(keys, order)))
    placed = number_in_order(scratch.keep(sorted_, "rows"), by, keys, "_place", scratch)
    return placed.withColumn(name, minted_id(prefix, F.col("_place") + 1)).drop("_place", *keys)


def new_rows(rows: DataFrame, existing: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Insert-or-ignore: first row of each key that ``existing`` doesn't have."""
    on = reduce(lambda a, b: a & b, (F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key))
    return first_of(rows, list(key), order).alias("n").join(existing.select(*key).alias("o"), on, "left_anti")
