import random
import re

from evidentia.llm import urls
from evidentia.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, host string, verdict int, rank double"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 0.5) for i, u, h in rows], SCHEMA)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute(rows, rules=urls.RULES, d=0.85, rounds=20, margin=0.25):
    out, count, links = [], {}, {}
    for i, u, html in rows:
        host, path = split(u)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        v, rule = max(fits, default=(0, None, None))[1:]
        out.append((i, host, path, rule, v))
        if not host:
            continue
        c = count.setdefault(host, [0, 0, 0])
        c[0] += 1
        c[1] += v == "allow"
        c[2] += v == "block"
        for other in {ascii_lower(x) for x in re.findall(urls.LINK, html or "")} - {host}:
            links[host, other] = links.get((host, other), 0) + 1
    hosts = {*count, *(b for _, b in links)}
    ranks = {}
    for kind in (1, 2):
        ways = {k if kind == 1 else k[::-1]: n for k, n in links.items()}
        total = {}
        for (a, _), n in ways.items():
            total[a] = total.get(a, 0) + n
        share = {h: count[h][kind] / count[h][0] if h in count else 0 for h in hosts}
        whole = sum(share.values()) or 1
        seed = {h: s / whole for h, s in share.items()}
        rank = dict(seed)
        for _ in range(rounds):
            back = sum(r for h, r in rank.items() if h not in total)
            new = {h: (1 - d) * seed[h] + d * back * seed[h] for h in hosts}
            for (a, b), n in ways.items():
                new[b] += d * rank[a] * n / total[a]
            rank = new
        ranks[kind] = rank
    bad = {h: len(hosts) * (ranks[2][h] - ranks[1][h]) > margin for h in hosts}
    told = {h: (count.get(h, [0])[0], len(hosts) * ranks[1][h], len(hosts) * ranks[2][h], bad[h]) for h in hosts}
    return [(i, h, p, r, v or ("block" if bad.get(h) else "allow")) for i, h, p, r, v in out], told


def corpus(seed=2, n=400):
    r = random.Random(seed)
    hosts = [f"{r.choice('abcdefghij')}{k}.example.{r.choice(['com', 'net', 'org'])}" for k in range(40)] + ["Other.Site", "far.away"]
    rows = []
    for i in range(n):
        host = hosts[0] if i % 3 == 0 else r.choice(hosts)
        links = "".join(f'<a href="{r.choice(["http:", "https:", ""])}//{r.choice(hosts)}/{k}?x#y">' for k in range(r.randint(0, 4)))
        rows.append((i, f"http{r.choice(['', 's'])}://{host}/{r.choice(['en', 'de', 'fr'])}/{i}{r.choice(['', '?q=a://b/', '#t'])}", f"<a href='/home'>{links}<img SRC = //cdn.only.linked/x>"))
    return rows


ODD = [
    (1, None, None), (2, "", "<a href=//a.b>"), (3, "no scheme/en/", None), (4, "http://", None), (5, "http://example.net", None), (6, "x://EXAMPLE.net/en/", None),
    (7, "http://badexample.net/en/", None), (8, "http://a.org/fr", None), (9, "http://net/", None), (10, "http://sub.net/en/", None), (11, "http://u@a.org:80/fr/", None),
    (12, "http://a.com?x=http://b.net/", None), (13, "://a.org#/fr/", None), (None, "http://q.org/fr/x", "x" * 100000), (14, "a\nb://c.net/d", None), (14, "a\nb://c.net/d", None),
    (15, "http://..net/", None), (16, "http://\u0130.org/fr/ü?", None),
]


def check(spark, rows, rules=urls.RULES, **options):
    got, told = urls.judged(frame(spark, rows).repartition(3), rules, rounds=6, **options)
    want, hosts = brute(rows, rules, rounds=6)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    found = {r.host: r for r in told.collect()}
    assert found.keys() == hosts.keys()
    for h, (n, trust, distrust, bad) in hosts.items():
        assert found[h].pages == n and abs(found[h].trust - trust) < 1e-6 and abs(found[h].distrust - distrust) < 1e-6 and (found[h].verdict == "block") == bad
    return want


def test_matches_brute_force(spark):
    want = check(spark, corpus() + ODD)
    assert {(w[3] is None, w[4]) for w in want} == {(a, b) for a in (True, False) for b in ("allow", "block")}


def test_edges_in_blocks_and_other_rules(spark):
    """Hosts with more edges than a block, rules that overlap, are equally long, and name no host."""
    rules = [("block", "example.com", "/"), ("allow", "example.com", "/e"), ("block", "example.com", "/e"), ("allow", "", ""), ("block", "b1.example.net", "/de/1"), ("allow", "com", "/fr/")]
    rows = corpus(7, 300) + [(1000 + i, "http://hub.org/fr/", "".join(f"<a href=//t{k}.example.com/>" for k in range(60))) for i in range(100)]
    got = urls.judged(frame(spark, rows), rules, rounds=3, block=7)[0].collect()
    two = {r.page_id: tuple(r) for r in urls.judged(frame(spark, rows), rules, rounds=3)[0].collect()}
    assert {r.page_id: tuple(r) for r in got} == two
    longest = {r.page_id: r for r in got}
    assert all(r.rule == "example.com/e" and r.verdict == "block" for r in longest.values() if r.host.endswith("example.com") and r.path.startswith("/e"))


def test_trust_and_distrust_spread(spark):
    rows = [(1, "http://good.org/fr/", '<a href="http://friend.io/">'), (2, "http://farm.io/", '<a href="http://bad.net/">'), (3, "http://friend.io/", ""), (4, "http://bad.net/", ""), (5, "http://alone.io/", "")]
    got, told = urls.judged(frame(spark, rows))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: ("org/fr/", "allow"), 2: (None, "block"), 3: (None, "allow"), 4: ("net/", "block"), 5: (None, "allow")}
    known = {r.host: r for r in told.collect()}
    assert known["friend.io"].trust > 0.5 and known["friend.io"].distrust == 0 and known["alone.io"].trust == 0


def test_empty(spark):
    got, told = urls.judged(frame(spark, []))
    assert got.collect() == [] and told.collect() == []
    assert len(check(spark, [(1, "http://a.io/", "<a href=//b.io>")])) == 1


def test_ranks_sum_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "c", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 3.0)], "host string, trust double, distrust double")
    got = urls.propagate(edges, seeds, Scratch(spark, "test"), rounds=8).agg(F.sum("trust"), F.sum("distrust")).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 1) < 1e-9
