"""Address rules and trust over links: against plain Python, and defined results for odd rows."""

from collections import Counter, defaultdict
from math import floor

import pytest

from fanplume.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from fanplume.llm.url_filter import UNIT, Rule, judge_urls
from pyspark.sql import functions as F


def test_query_equals_sql(same):
    same(QUERIES["op11_url_filter"], ORACLE_SQL["op11_url_filter"])


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op11_url_filter"](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def lower(host):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([len(s), *(s.index(c) for c in stops if c in s)])]
    host = cut(rest, "/?#")
    return lower(host), cut(rest[len(host) :], "?#")


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def brute(pages, rules, links, kin=1, rounds=20, damping=0.85, margin=2.0):
    """links: (source host, target host) of each link."""
    parsed = {p: parse(u) for p, u, _ in pages}
    edges, hosts = Counter((a, b) for a, b in links if a), {h for h, _ in parsed.values() if h} | {b for _, b in links}
    pairs = set()
    for h in hosts:
        while kin and h.count(".") > 1 and not set(h) <= set("0123456789.:"):
            up = h.split(".", 1)[1]
            pairs |= {(h, up), (up, h)}
            h = up
    for pair in pairs:
        edges[pair] += kin
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    rule = {p: rule_of(*hp, rules) for p, hp in parsed.items()}
    score = {}
    for side, verdict in (("trust", "allow"), ("distrust", "block")):
        own = [((a, b) if side == "trust" else (b, a), w) for (a, b), w in edges.items()]
        out = Counter()
        for (a, _), w in own:
            out[a] += w
        seeds = Counter(parsed[p][0] for p in parsed if rule[p] and rule[p].verdict == verdict)
        mass = {h: n * UNIT for h, n in seeds.items()}
        start = dict(mass)
        for _ in range(rounds):
            new = defaultdict(int, {h: floor((1 - damping) * m) for h, m in start.items()})
            for (a, b), w in own:
                if a in mass:
                    new[b] += floor(mass[a] * (damping * w / out[a]))
            mass = dict(new)
        score[side] = mass
    result = {}
    for p, (h, path) in parsed.items():
        t, d = score["trust"].get(h, 0), score["distrust"].get(h, 0)
        result[p] = (h, path, rule[p].text if rule[p] else None, rule[p].verdict if rule[p] else "block" if d > margin * t else "allow", t, d)
    return result


def plain(df):
    return {r["page_id"]: tuple(r[n] for n in ("host", "path", "rule", "verdict", "trust", "distrust")) for r in df.collect()}


WEB = [
    (1, "https://News.Example.ORG/en/2?x=/es/", '<A class=x HREF="//partner.net/a">p</A> <a href="https://other.net:80/x?y">o</a><a href="/own">', [("news.example.org", "partner.net"), ("news.example.org", "other.net:80")]),
    (2, "http://example.org/es/1", "<a href=http://partner.net>p</a>", [("example.org", "partner.net")]),
    (3, "http://farm.spam.net/x", "<a href='http://bad.com/de/'>1</a><a\nhref = \"http://bad.com/de/2\">2</a>", [("farm.spam.net", "bad.com")] * 2),
    (4, "http://bad.com/de/#/fr/", None, []), (5, "http://bad.com/en/", "", []), (6, "http://bad.com/de/9", "<a href='http://bad.com/'>self</a>", [("bad.com", "bad.com")]),
    (7, "http://partner.net", "<p>no links</p>", []), (8, None, "<a href='http://x.net/'>lost</a>", []), (9, "no address", "", []), (10, "://", "", []), (11, "http://good.com/fr/1", "<a href='http://linked.net'>", [("good.com", "linked.net")]),
    (12, "http://linked.net/?q#f", "<a href='http://1.2.3.4/'> <a <a <a title='>' href='http://after.net'>", [("linked.net", "1.2.3.4")]), (13, "http://1.2.3.4/x/y", " ", []), (14, "http://example.org/en/12", "", []), (15, "http://notexample.org", "", []),
    (16, "ftp://User@Example.org:21/es/", "", []), (17, "http://example.org\n/es/", "", []),
]


@pytest.fixture(scope="module")
def web(spark):
    return spark.createDataFrame([w[:3] for w in WEB], "page_id long, url string, html string")


@pytest.mark.parametrize(("kin", "rounds"), [(0, 20), (1, 20), (3, 7)])
def test_web_equals_plain_python(web, kin, rounds):
    links = [x for w in WEB for x in w[3]]
    got = plain(judge_urls(web, URL_RULES, kin=kin, rounds=rounds))
    assert got == brute([w[:3] for w in WEB], URL_RULES, links, kin, rounds)


def test_distrust_runs_against_links_and_trust_along_them(web):
    got = plain(judge_urls(web, URL_RULES, kin=0))
    assert got[3][3] == "block" and got[3][5] > 0  # it links to blocked pages
    assert got[5][3] == "block"  # most pages of its host are blocked
    assert got[7][3] == "allow" and got[7][4] > got[7][5]  # a trusted host links to it
    assert got[12][4] > 0 and got[12][3] == "allow"
    assert [got[k][:4] for k in (8, 9, 10)] == [("", "", None, "allow")] * 3


def test_repeated_empty_and_clashing(spark, web):
    twice = judge_urls(web.unionByName(web), URL_RULES).groupBy("page_id").count().filter("count <> 2").count()
    assert twice == 0
    assert judge_urls(web.filter("false"), URL_RULES).count() == 0
    assert plain(judge_urls(web, [])) == {k: (*v[:2], None, "allow", 0, 0) for k, v in plain(judge_urls(web, URL_RULES)).items()}
    names = ["host", "path", "rule", "verdict", "trust", "distrust", "src", "dst", "side", "mass", "share", "weight"]
    extra = judge_urls(web.select("*", *(F.lit("own").alias(n) for n in names)), URL_RULES)
    assert plain(extra) == plain(judge_urls(web, URL_RULES))
    assert {r["src"] for r in extra.select("src").collect()} == {"own"}


def test_long_texts_take_linear_time(spark):
    odd = ["<a " * 300_000, "<a href" * 150_000, "<a href=" + " " * 1_000_000, "<a " + "href " * 200_000, "x" * 3_000_000]
    df = spark.createDataFrame([(i, f"http://h{i}.com/fr/", t) for i, t in enumerate(odd)], "page_id long, url string, html string")
    assert {v[3] for v in plain(judge_urls(df, [Rule("allow", "com", "/fr/")])).values()} == {"allow"}
