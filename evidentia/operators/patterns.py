"""Many patterns against many symbols, by an inverted index of q-grams.

Patterns are rows: they may differ by engagement and come in any number. Distinct
symbols are cut into lower-cased grams of the sizes that patterns need. A pattern
waits at the gram of its own that the fewest symbols have, meets the symbols
there on equal keys, and is verified. Patterns of one or two characters wait at
grams of that length, which is exact; those without any letter to wait at meet
all symbols of their engagement, as they may match them all. No pair of pattern
and symbol is formed that does not share a gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scalars import leaf
from evidentia.scratch import Scratch

Q = 3
#: Symbols of a gram are dealt to so many salts; patterns, which are few, are there once for each.
SALTS = 16

CONTAINS, LIKE = "contains", "like"


def _same(columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{prefix}{c}") for c in columns), F.lit(True))


def grams(text: Column, size: Column | int) -> Column:
    """Distinct grams of one size."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _waits(pattern: Column, kind: Column) -> Column:
    """What a pattern must hold as it is written, lower-cased: runs of ASCII without wild cards. Other
    characters may change with their case, so no gram is taken from them."""
    plain = F.regexp_replace(F.lower(pattern), r"[^\x00-\x7F]", "\u0080")
    return F.split(F.when(kind == LIKE, F.regexp_replace(plain, r"\\.|[%_\\]", "\u0080")).otherwise(plain), "\u0080")


def matches(symbols: DataFrame, patterns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (``by``, ``symbol``, ``pattern``, ``kind``) that match.

    ``symbols`` has ``by`` (such as an engagement) and ``symbol``; ``patterns`` has ``by``, ``pattern`` and ``kind``: ``contains``
    (the text anywhere, by case) or ``like`` (SQL's LIKE, case aside). Rows that repeat
    count once, null symbols and patterns match nothing, an empty ``contains`` matches all."""
    by = by or []
    scratch = Scratch(symbols.sparkSession, "patterns")
    known = scratch.keep(symbols.select(*by, "symbol").where("symbol IS NOT NULL").distinct(), "symbols")
    asked = patterns.select(*by, "pattern", "kind").where("pattern IS NOT NULL").distinct()
    longest = F.array_max(F.transform(_waits(F.col("pattern"), F.col("kind")), lambda r: F.length(r)))
    asked = scratch.keep(asked.withColumn("size", F.least(F.lit(Q), longest)), "asked")
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())  # 0 to Q
    cut = F.flatten(F.array(*(grams(F.lower("symbol"), n) for n in sizes if n))) if any(sizes) else F.array().cast("array<string>")
    index = known.select(*by, "symbol", F.explode(cut).alias("gram"))
    own = F.array_distinct(F.flatten(F.transform(_waits(F.col("pattern"), F.col("kind")), lambda r: grams(r, F.col("size")))))
    wanted = asked.where("size > 0").select(*by, "pattern", "kind", F.explode(own).alias("gram"))
    grams_of = wanted.select(*(F.col(c).alias(f"_w_{c}") for c in (*by, "gram"))).distinct()
    posted = scratch.keep(index.join(grams_of, _same([*by, "gram"], "_w_"), "left_semi"), "postings")
    counts = posted.groupBy(*(F.col(c).alias(f"_c_{c}") for c in (*by, "gram"))).agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no symbol has rules the pattern out: it is the rarest, and nothing waits there
    rarest = wanted.join(counts, _same([*by, "gram"], "_c_"), "left").groupBy(*by, "pattern", "kind").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("g"))
    at = rarest.select(*(F.col(c).alias(f"_a_{c}") for c in by), F.col("g.gram").alias("_a_gram"), "pattern", "kind", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_a__salt"))
    dealt = posted.withColumn("_salt", F.pmod(F.xxhash64("symbol"), F.lit(SALTS)).cast("int"))
    met = dealt.join(at, _same([*by, "gram", "_salt"], "_a_")).select(*by, "symbol", "pattern", "kind")
    if 0 in sizes:
        free = asked.where("size = 0").select(*(F.col(c).alias(f"_e_{c}") for c in by), "pattern", "kind", F.lit(0).alias("_e__all"))
        met = met.unionByName(known.withColumn("_all", F.lit(0)).join(free, _same([*by, "_all"], "_e_")).select(*by, "symbol", "pattern", "kind"))
    holds = F.when(F.col("kind") == LIKE, F.expr("symbol ILIKE pattern")).otherwise(F.contains("symbol", "pattern"))
    return met.where(holds)


def seeds(edges: DataFrame, sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (``by``, ``source``, ``seed``): symbols that hold a source's text, or end in its leaf after a colon,
    case aside. ``sources`` has ``by`` and ``pattern``."""
    by = by or []
    asked = sources.select(*by, F.col("pattern").alias("source")).where("source IS NOT NULL").distinct()
    forms = asked.select(*by, "source", F.explode(F.array(F.concat(F.lit("%"), "source", F.lit("%")), F.concat(F.lit("%:"), leaf(F.col("source"))))).alias("pattern"), F.lit(LIKE).alias("kind"))
    found = matches(edges.select(*by, F.col("from_symbol").alias("symbol")), forms, by)
    named = forms.select(*(F.col(c).alias(f"_f_{c}") for c in (*by, "pattern")), "source")
    return found.join(named, _same([*by, "pattern"], "_f_")).select(*by, "source", F.col("symbol").alias("seed")).distinct()


def holding(symbols: DataFrame, patterns: DataFrame, by: list[str] | None = None, leaves: bool = False) -> DataFrame:
    """Distinct (``by``, ``symbol``) that hold the text of a pattern (``by``, ``pattern``); with ``leaves`` (sinks) its leaf will do, too.
    Empty patterns hold nowhere."""
    by = by or []
    forms = F.array("pattern", leaf(F.col("pattern"))) if leaves else F.array("pattern")
    asked = patterns.select(*by, F.explode(forms).alias("pattern"), F.lit(CONTAINS).alias("kind")).where("pattern != ''")
    return matches(symbols, asked, by).select(*by, "symbol").distinct()
