"""URL filters: rules by host and path, and trust that spreads over links.

Rules decide the URLs that they fit. They also say which hosts to start from:
trust spreads from hosts with allowed pages along links, distrust from hosts
with blocked pages against them, to the hosts that link there. Both are
personalised PageRanks over one table of host edges, iterated together. A host
whose distrust outweighs its trust by a margin is blocked where no rule says
otherwise.

Edges are counted per pair of hosts before they are shuffled, and written once
in blocks: the edges of a host are dealt to blocks of ``BLOCK``, its rank is sent
to each, so no task holds all links of a host. Pages meet their host's verdict
in a join that keeps hot hosts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, join_by_count

#: (verdict, host, path): a rule fits the host and its subdomains where the path begins with its own.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING, ROUNDS, MARGIN = 0.85, 20, 0.25
#: Ranks have settled when they all change by less than this together.
SETTLED = 1e-12
BLOCK = 100_000
#: Verdicts don't hang on the last digits of sums, which depend on their order.
SLACK = 1e-9

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The host of an absolute or scheme-relative link in an attribute of a tag.
LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'<>\x00-\x20]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """A host and its parent domains: ``a.b.c``, ``b.c``, ``c``."""
    names = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))


def rules_by_host(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct ``host`` with ``rules``: those of the host and its parent domains as
    (rule, path, verdict), the longest first; of equally long ones ``block``, then by text."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(h, h + p, p, v) for v, h, p in rules], "_of string, rule string, path string, verdict string").distinct()
    named = hosts.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("_suffix"))
    met = named.join(table, F.col("_suffix") == F.col("_of"))
    order = F.struct((-F.length("rule")).alias("l"), (F.col("verdict") != "block").alias("v"), "rule", "path", "verdict")
    return met.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path"), r["verdict"].alias("verdict"))).alias("rules"))


def _ruled(rows: DataFrame, hosts: DataFrame, rules: list[tuple[str, str, str]], scratch: Scratch) -> DataFrame:
    """``rows`` with ``rule`` and ``by_rule``, null where no rule fits."""
    mine = rules_by_host(hosts, rules).join(hosts.select(F.col("host").alias("_h"), "n"), F.col("host") == F.col("_h")).drop("_h")
    mine = scratch.keep(mine, "rules")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_by_count(rows, mine, ["host"], total, "left")
    first = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    return met.withColumn("_r", first).select(*rows.columns, F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``n``: pages of a host that link to another one, from the absolute and
    scheme-relative links of ``html``. Links within a host say nothing about others."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    each = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(links, _lower))).alias("dst"))
    return each.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """Personalised PageRank of two kinds at once: ``host``, ``trust``, ``distrust``.

    ``seeds`` has ``host``, ``trust``, ``distrust``, weights that are not negative, for hosts of any
    edge or page, each once. Trust flows along ``edges`` (``src``, ``dst``, ``n``) in proportion to
    ``n``, distrust against them; what reaches a host without a way on returns to
    the seeds. Ranks of a kind sum to 1, or are 0 where nothing is a seed.
    ``rounds`` is a bound: iteration ends when ranks have settled."""
    kinds = {"trust": ("src", "dst"), "distrust": ("dst", "src")}
    ways = [edges.select(F.lit(k).alias("kind"), F.col(a).alias("_from"), F.col(b).alias("_to"), "n") for k, (a, b) in kinds.items()]
    ways = ways[0].unionByName(ways[1])
    out = ways.groupBy("kind", "_from").agg(F.sum("n").alias("out"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    out = scratch.keep(out, "out")
    sums = seeds.agg(*(F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in kinds)).first()
    each = [seeds.select(F.lit(k).alias("kind"), "host", (F.col(k) / F.lit(sums[k] or 1.0)).alias("seed")) for k in kinds if sums[k]]
    if not each:
        return seeds.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    nodes = each[0].unionByName(each[1]) if len(each) > 1 else each[0]
    nodes = nodes.join(out, (nodes.kind == out.kind) & (F.col("host") == F.col("_from")), "left").select(nodes.kind, "host", "seed", F.coalesce("parts", F.lit(0)).alias("parts"), "out")
    dealt = ways.join(out.select(F.col("kind").alias("_k"), F.col("_from").alias("_f"), "parts"), (F.col("kind") == F.col("_k")) & (F.col("_from") == F.col("_f")))
    dealt = scratch.keep(dealt.select("kind", "_from", F.pmod(F.xxhash64("_to"), F.col("parts")).cast("int").alias("part"), "_to", "n"), "edges")

    def kept(ranks: DataFrame, name: str, old: Column) -> tuple[DataFrame, dict]:
        told = Observation()
        stuck = lambda k: F.sum(F.when((F.col("kind") == k) & (F.col("parts") == 0), F.col("rank")).otherwise(0.0)).alias(k)
        seen = ranks.observe(told, *map(stuck, kinds), F.sum(F.abs(F.col("rank") - old)).alias("change"))
        return scratch.keep(seen.select("kind", "host", "seed", "parts", "out", "rank"), name), told.get

    ranks, told = kept(nodes.withColumn("rank", F.col("seed")), "rank_0", F.lit(0.0))
    for turn in range(1, rounds + 1):
        sent = ranks.where("parts > 0").select(
            F.col("kind").alias("_k"), F.col("host").alias("_f"), (F.col("rank") / F.col("out")).alias("_each"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_p")
        )
        met = dealt.join(sent, (F.col("kind") == F.col("_k")) & (F.col("_from") == F.col("_f")) & (F.col("part") == F.col("_p")))
        got = met.groupBy(F.col("kind").alias("_k"), F.col("_to").alias("_t")).agg(F.sum(F.col("_each") * F.col("n")).alias("got"))
        back = F.when(F.col("kind") == "trust", F.lit(told["trust"] or 0.0)).otherwise(F.lit(told["distrust"] or 0.0))
        rank = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + back * F.col("seed"))
        new = ranks.join(got, (F.col("kind") == F.col("_k")) & (F.col("host") == F.col("_t")), "left").withColumn("_new", rank)
        new = new.select("kind", "host", "seed", "parts", "out", F.col("_new").alias("rank"), F.col("rank").alias("_old"))
        ranks, told = kept(new, f"rank_{turn}", F.col("_old"))
        scratch.free(f"rank_{turn - 1}")
        if (told["change"] or 0.0) < SETTLED:
            break
    side = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    return ranks.groupBy("host").agg(*map(side, kinds))


def judged(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, margin: float = MARGIN, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Verdicts for the rows of ``pages`` (``page_id``, ``url``, ``html``), and what is known of hosts.

    The first table has ``page_id``, ``host``, ``path``, ``rule`` (host and path of the longest rule
    that fits, or null) and ``verdict``: the rule's, or else the host's. The second one
    has ``host``, ``pages``, ``trust``, ``distrust`` (ranks as multiples of the mean) and ``verdict``:
    ``block`` where distrust exceeds trust by more than ``margin``, else ``allow``. A host is
    a seed by the shares of its pages that rules allow and block; hosts that are
    only linked to take part, too. A null url, or one without ``://``, has an empty host
    and path; such pages fit no rule that names a host, take no part in the graph
    and are allowed where no rule of the empty host says otherwise. Null html has
    no links; repeated rows count each; other columns are ignored; an empty table
    gives no rows."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = scratch.keep(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "rows")
    hosts = scratch.keep(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    ruled = scratch.keep(_ruled(rows, hosts, rules, scratch), "ruled")
    edges = scratch.keep(host_edges(pages), "links")
    by = lambda v: F.count_if(F.col("by_rule") == v)
    named = ruled.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), (by("allow") / F.count(F.lit(1))).alias("trust"), (by("block") / F.count(F.lit(1))).alias("distrust"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0).cast("long").alias("pages"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    seeds = named.unionByName(linked).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "trust", "distrust")))
    seeds = scratch.keep(seeds, "seeds")
    ranks = propagate(edges, seeds, scratch, damping, rounds, block)
    n = seeds.count()
    told = seeds.select("host", "pages").join(ranks, "host", "left").select("host", "pages", *((F.coalesce(c, F.lit(0.0)) * n).alias(c) for c in ("trust", "distrust")))
    bad = F.col("distrust") - F.col("trust") > margin + SLACK
    told = scratch.keep(told.withColumn("verdict", F.when(bad, "block").otherwise("allow")), "verdicts")
    open_ = join_by_count(ruled, told.select("host", F.col("pages").alias("n"), F.col("verdict").alias("_by_host")), ["host"], how="left")
    verdict = F.coalesce("by_rule", "_by_host", F.lit("allow"))
    return open_.select("page_id", "host", "path", "rule", verdict.alias("verdict")), told


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages``, a row a row of the table; see :func:`judged` for nulls and repeated rows."""
    return judged(documents(spark, sf_dir, "pages"))[0]


def oracle_sql(rounds: int = ROUNDS, damping: float = DAMPING, margin: float = MARGIN) -> str:
    """DuckDB SQL of :func:`op12_url_filter`; all rounds are run."""
    rules = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in RULES)
    lower = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    link = LINK.replace("'", "''")
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"""g{i} AS (SELECT w.kind, w.t AS host, sum(r.rank * w.n / outs.o) AS got FROM ways w JOIN outs ON outs.kind = w.kind AND outs.f = w.f JOIN r{i - 1} r ON r.kind = w.kind AND r.host = w.f GROUP BY ALL),
b{i} AS (SELECT r.kind, sum(CASE WHEN outs.f IS NULL THEN r.rank ELSE 0 END) AS back FROM r{i - 1} r LEFT JOIN outs ON outs.kind = r.kind AND outs.f = r.host GROUP BY ALL),
r{i} AS MATERIALIZED (SELECT r.kind, r.host, r.seed, {1 - damping} * r.seed + {damping} * (coalesce(g.got, 0) + b.back * r.seed) AS rank
  FROM r{i - 1} r LEFT JOIN g{i} g ON g.kind = r.kind AND g.host = r.host JOIN b{i} b ON b.kind = r.kind)""")
    return f"""
WITH rules(v, h, p, rule) AS (VALUES {rules}),
x AS MATERIALIZED (SELECT row_number() OVER () AS row, page_id, html, {lower("regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS MATERIALIZED (SELECT x.row, any_value(page_id) AS page_id, any_value(x.host) AS host, any_value(path) AS path,
  arg_max(rule, (length(rule), v, rule)) AS rule, arg_max(v, (length(rule), v, rule)) AS v
  FROM x LEFT JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(path, p) GROUP BY x.row),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda l: {lower('l')}))) AS dst FROM x)
  WHERE src <> '' AND src <> dst GROUP BY ALL),
s AS (SELECT host, count(v) FILTER (WHERE v = 'allow') / count(*) AS trust, count(v) FILTER (WHERE v = 'block') / count(*) AS distrust FROM m WHERE host <> '' GROUP BY host
  UNION ALL SELECT unnest([src, dst]), 0, 0 FROM e),
hosts AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM s GROUP BY host),
ways AS MATERIALIZED (SELECT 'trust' AS kind, src AS f, dst AS t, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
outs AS MATERIALIZED (SELECT kind, f, sum(n) AS o FROM ways GROUP BY ALL),
r0 AS MATERIALIZED (SELECT kind, host, seed, seed AS rank FROM (SELECT 'trust' AS kind, host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0) AS seed FROM hosts
  UNION ALL SELECT 'distrust', host, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0) FROM hosts)),
{(',' + chr(10)).join(steps)},
k AS (SELECT host, (SELECT count(*) FROM hosts) * (sum(rank) FILTER (WHERE kind = 'distrust') - sum(rank) FILTER (WHERE kind = 'trust')) > {margin} + {SLACK} AS bad FROM r{rounds} GROUP BY host)
SELECT page_id, m.host, path, rule, coalesce(v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN k ON m.host = k.host
"""
