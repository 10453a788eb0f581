"""Licence scans by diagonal voting, in DataFrame functions only.

Every document and every template is a word sequence. Hashes of all word
bigrams of a document join the hashes of the template bigrams; a match of
document position p and template position t votes for the diagonal p - t. A
run of votes on one diagonal is a verbatim copy, runs on neighbouring
diagonals are a copy with words put in or left out. A diagonal's votes are the
template positions that it met, each once, so its row is no longer than the
template, and the tally is combined before it is shuffled: a document without
matches costs one row. Where diagonals are merged, positions are bits of words
of ``BITS`` bits, so that a text that repeats itself costs no more, either.
Templates may be of any length: one line or a whole licence. A hash match
counts only if the words are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Phrases that count wherever their words stand consecutively: (label, words).
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
    "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)

#: Notices and whole licences that are found with small differences, too: (label, words).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
        "or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at https mozilla org mpl 2 0",
    ),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-text", f"{BSD_GRANT} {BSD_DISCLAIMER}"),
    (
        "bsd-3-text",
        f"{BSD_GRANT} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission {BSD_DISCLAIMER}",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
]

#: Function words; a bigram of two of them is no seed of a notice.
COMMON = frozenset("a an and any are as at be by can for from in is it of on or that the this to with you".split())

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS = 63  # template positions of one word of bits
WHOLE, NEAR, SINGLE = 0, 1, 2  # parts of an island


def seeds_of(words: str, exact: bool) -> list[tuple[int, str]]:
    """(position, bigram) for each seed of a template."""
    w = words.split()
    pairs = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(w, w[1:])) if exact or not {a, b} <= COMMON]
    if not pairs:
        raise ValueError(f"a template has two words in a row that are not both function words: {words!r}")
    return pairs


def templates(phrases: list = PHRASES, notices: list = NOTICES) -> list[tuple[int, str, bool, int, int, str]]:
    """Rows (template, label, exact, n_seeds, position, bigram)."""
    rows = []
    for number, (label, words, exact) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        seeds = seeds_of(words, exact)
        rows += [(number, label, exact, len(seeds), at, gram) for at, gram in seeds]
    return rows


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def spans(
    docs: DataFrame, phrases: list = PHRASES, notices: list = NOTICES, slack: int = 3, least_votes: int = 2, coverage: float = 0.6
) -> DataFrame:
    """Verified spans of templates in whole texts, at least one row for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    ``row_id``, ``doc_id``, ``n_words`` and, null where a document has no span,
    ``label``, ``exact``, ``start`` and ``end`` (words from 0, end excluded) and
    ``coverage``. A phrase is a span where all its words stand consecutively. A
    notice is a span where diagonals at most ``slack`` apart, one of them with at
    least ``least_votes`` votes, together match the share ``coverage`` of its seeds within
    twice its length. Where they do not, as beside a phrase that repeats, the
    strongest diagonal with those at most ``slack`` from it, and each diagonal by
    itself, are judged in the same way. Null and empty texts have no words and no span; repeated
    rows are scanned each for themselves; a null doc_id is kept as it is.
    """
    spark = docs.sparkSession
    table = [(t, at, gram) for t, _, _, _, at, gram in templates(phrases, notices)]
    seeds = spark.createDataFrame(table, "template int, at int, seed string")  # as many rows as template words
    seeds = seeds.withColumn("seed_hash", F.xxhash64("seed"))

    words = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words_of(F.col("text")).alias("w"))
    grams = words.select(
        "row_id", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 2147483647).alias("b"))).alias("pos", "pair"),
    ).select("row_id", "doc_id", "n_words", "pos", F.concat("pair.a", F.lit(" "), "pair.b").alias("gram"))
    voted = grams.withColumn("gram_hash", F.xxhash64("gram")).join(
        F.broadcast(seeds), (F.col("gram_hash") == F.col("seed_hash")) & (F.col("gram") == F.col("seed")), "left"
    )
    # a place of a document meets one template position a diagonal: the list has no repeats
    diagonals = voted.groupBy("row_id", "doc_id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_list("at").alias("hits")
    )

    kinds = [(r[0], r[1], r[2], r[3]) for r in templates(phrases, notices)]
    kinds = spark.createDataFrame(sorted({*kinds}), "template int, label string, exact boolean, n_seeds int")
    known = diagonals.join(F.broadcast(kinds), "template", "left")
    votes = F.size("hits")
    strong = ~F.col("exact") | (votes == F.col("n_seeds"))
    # a row that fails keeps its document: it loses its template
    for c in ("template", "label", "exact", "diagonal", "hits"):
        known = known.withColumn(f"_{c}", F.when(strong, F.col(c)))
    known = known.select("row_id", "doc_id", "n_words", "n_seeds", *(F.col(f"_{c}").alias(c) for c in ("template", "label", "exact", "diagonal", "hits")))

    along = Window.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)
    islands = known.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("island", F.sum("_new").over(along))
    # An island of several diagonals is judged as a whole, around its strongest diagonal, and diagonal by
    # diagonal: repeats that chain to a copy make the whole too wide, but not what is near the copy.
    within = Window.partitionBy("row_id", "template", "island")
    islands = islands.withColumn("_size", F.count(F.lit(1)).over(within)).withColumn(
        "_best", F.max_by("diagonal", F.struct(F.size("hits"), -F.col("diagonal"))).over(within)
    )
    part = lambda kind, own: F.struct(F.lit(kind).alias("kind"), own.cast("int").alias("own"))
    near = F.when(F.abs(F.col("diagonal") - F.col("_best")) <= slack, part(NEAR, F.lit(0)))
    several = ~F.col("exact") & (F.col("_size") > 1)
    whole = part(WHOLE, F.lit(0))
    parts = F.when(several, F.array_compact(F.array(whole, near, part(SINGLE, F.col("diagonal"))))).otherwise(F.array(whole))
    # the window has dealt rows by row_id and template; the aggregates and windows below stay within that
    island = ["row_id", "doc_id", "n_words", "template", "label", "exact", "n_seeds", "island", "_best", "part"]
    judged = islands.withColumn("part", F.explode(parts))
    met = judged.select(*island, "diagonal", F.size("hits").alias("votes"), F.explode_outer("hits").alias("at"))
    words_ = met.groupBy(*island, F.floor(F.col("at") / BITS).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % BITS).cast("int"))).alias("bits"),
        F.max("votes").alias("most"), F.min(F.col("diagonal") + F.col("at")).alias("start"), F.max(F.col("diagonal") + F.col("at") + 2).alias("end"),
    )
    merged = words_.groupBy(*island).agg(
        F.sum(F.bit_count("bits")).alias("n"), F.max("most").alias("most"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    share = F.col("n") / F.col("n_seeds")
    length = F.col("n") + 1
    holds = F.col("exact") | ((F.col("most") >= F.least("n_seeds", F.lit(least_votes))) & (share >= coverage) & (F.col("end") - F.col("start") <= 2 * F.greatest(length, F.col("n_seeds") + 1)))
    # the whole goes before its parts; around the strongest diagonal the group counts if it says more than that diagonal
    kind, own = F.col("part.kind"), F.col("part.own")
    merged = merged.withColumn("_holds", holds).withColumn("_first", F.min(F.when(F.col("_holds"), kind)).over(within))
    merged = merged.withColumn("_more", F.max(F.when(kind == NEAR, F.col("n"))).over(within) > F.max(F.when((kind == SINGLE) & (own == F.col("_best")), F.col("n")).otherwise(0)).over(within))
    about = F.abs(own - F.col("_best")) <= slack
    part_told = F.when(kind == NEAR, F.col("_more")).when(kind == SINGLE, ~(about & F.col("_more") & (F.col("_first") == NEAR))).otherwise(True)
    told = F.col("_holds") & ((F.col("_first") != WHOLE) | (kind == WHOLE)) & part_told
    kept = lambda c: F.when(told, c)
    return merged.select(
        "row_id", "doc_id", "n_words", kept(F.col("label")).alias("label"), kept(F.col("exact")).alias("exact"),
        kept(F.col("start")).cast("long").alias("start"), kept(F.col("end")).cast("long").alias("end"), kept(share).alias("coverage"),
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for every row of ``docs``: what :func:`spans` found, in short.

    ``n_base``, ``first_word`` and ``last_word`` count and bound the places of
    phrases; ``labels`` has those of notices as well; ``score`` is the largest
    coverage of a span, 0 where there is none.
    """
    found = spans(docs, **options)
    base = F.col("exact") & F.col("label").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    ).drop("row_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, a row a row of the table. Null and empty texts have no words
    and no labels; repeated rows are scanned each for themselves; an empty table
    gives no rows."""
    return scan(documents(spark, sf_dir))


def oracle_sql(slack: int = 3, least_votes: int = 2, coverage: float = 0.6) -> str:
    """DuckDB SQL of :func:`op2_license_scan`."""
    values = ",\n".join(f"({t}, '{label}', {str(exact).lower()}, {n}, {at}, '{gram}')" for t, label, exact, n, at, gram in templates())
    return f"""
WITH seeds(template, label, exact, n_seeds, pos, gram) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM w),
g AS (SELECT doc_id, p, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM u),
d AS (SELECT doc_id, template, label, exact, n_seeds, p - pos AS diagonal,
        list_sort(list(DISTINCT pos)) AS hits FROM g JOIN seeds USING (gram) GROUP BY ALL),
s AS (SELECT * FROM d WHERE NOT exact OR len(hits) = n_seeds),
a AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {slack}
        THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM a),
b AS (SELECT *, count(*) OVER j AS size, max_by(diagonal, (len(hits), -diagonal)) OVER j AS best FROM i WINDOW j AS (PARTITION BY doc_id, template, island)),
c AS (SELECT *, 0 AS kind, 0 AS own FROM b UNION ALL SELECT *, 1, 0 FROM b WHERE NOT exact AND size > 1 AND abs(diagonal - best) <= {slack}
  UNION ALL SELECT *, 2, diagonal FROM b WHERE NOT exact AND size > 1),
m AS (SELECT doc_id, template, label, exact, n_seeds, island, kind, own, len(list_distinct(flatten(list(hits)))) AS n, max(len(hits)) AS most,
        min(diagonal + hits[1]) AS b, max(diagonal + hits[-1] + 2) AS e FROM c GROUP BY ALL),
k AS (SELECT *, n / n_seeds AS share FROM m WHERE exact OR
        (most >= least(n_seeds, {least_votes}) AND n / n_seeds >= {coverage} AND e - b <= 2 * greatest(n + 1, n_seeds + 1)))
SELECT w.doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words,
  CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS n_base,
  CAST(min(b) FILTER (WHERE exact) AS BIGINT) AS first_word,
  CAST(max(b) FILTER (WHERE exact) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), ','), '') AS labels,
  coalesce(max(share), 0.0) AS score
FROM w LEFT JOIN k ON w.doc_id = k.doc_id GROUP BY w.doc_id
"""
