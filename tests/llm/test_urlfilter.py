import random

import duckdb
import pytest

from pyspark.sql import functions as F

from tests.oracle import connect, same
from twinsift.llm import queries
from twinsift.llm import urlfilter as u

SCHEMA = "page_id long, url string, html string, host string, rule int"
RULES = [("org", "/", "allow"), ("bad.com", "/", "block"), ("bad.com", "/ok/", "allow"), ("x.bad.com", "/ok/", "block")]


def link(href):
    return f"<html><head><LINK data-a='1' rel='canonical' href=\"{href}\"></head>"


PAGES = [
    (1, "http://A.Bad.com/p?q#f", None),
    (2, "http://bad.com", None),  # no path, so no rule fits
    (3, "https://x.bad.com/ok/1", ""),
    (4, "https://y.bad.com/ok/1", ""),
    (5, "http://alias.net/one", link("http://a.bad.com/p2")),
    (6, "http://alias.net/two", link("/one")),
    (7, "https://alias.net/one#part", None),
    (8, "http://free.net/a", link("http://w.org/z")),
    (9, "http://free.net/b", link("//free.net/a")),
    (10, "http://free.net/b2", '<meta content="0; url=http://bad.com/k" http-equiv="refresh">' + link("http://free.net/b")),
    (11, "http://rel.net/d/e", '<meta http-equiv="Refresh" content="0;URL=f">'),
    (12, "http://rel.net/d/f", link("http://bad.com/r")),
    (13, None, link("http://bad.com/r")),
    (14, "", None),
    (15, "no scheme/bad.com/", None),
    (16, "http://://bad.com/", None),
    (17, "http://notbad.com/", None),
    (18, "ftp://moved.net/old", None),
    (19, "http://lone.net/", link("http://lone.net/")),
    (20, "http://up.net/a/b/c", link("../../../d")),
    (21, "http://up.net/d", link("http://bad.com/up")),
    (22, "http://go.net/x", link("/go?u=http://bad.com/x")),
    (23, "http://slow.net/", '<meta http-equiv="refresh" content="900;url=http://bad.com/s">'),
    (24, "http://q.net/s?a=1", link("?a=2&amp;b=3")),
    (25, "http://q.net/s?a=2&b=3", link("http://bad.com/q")),
    (26, "http://base.net/1/2", '<base href="/other/">' + link("./z")),
    (27, "http://base.net/other/z", link("http://bad.com/z")),
    (28, "http://mail.net/", link("mailto:a@bad.com")),
    (29, "http://self.net/p", link("#top")),
    (None, "http://bad.com/n", None),
    (1, "http://A.Bad.com/p?q#f", None),
]
WANT = {
    1: ("a.bad.com", "/p", "bad.com/", "block"),
    2: ("bad.com", "", None, "allow"),
    3: ("x.bad.com", "/ok/1", "x.bad.com/ok/", "block"),
    4: ("y.bad.com", "/ok/1", "bad.com/ok/", "allow"),
    5: ("alias.net", "/one", None, "block"),
    6: ("alias.net", "/two", None, "block"),
    7: ("alias.net", "/one", None, "block"),
    8: ("free.net", "/a", None, "allow"),
    9: ("free.net", "/b", None, "allow"),
    10: ("free.net", "/b2", None, "allow"),
    11: ("rel.net", "/d/e", None, "block"),
    12: ("rel.net", "/d/f", None, "block"),
    13: ("", "", None, "allow"),
    14: ("", "", None, "allow"),
    15: ("", "", None, "allow"),
    16: (":", "//bad.com/", None, "allow"),
    17: ("notbad.com", "/", None, "allow"),
    18: ("moved.net", "/old", None, "block"),
    19: ("lone.net", "/", None, "allow"),
    20: ("up.net", "/a/b/c", None, "block"),
    21: ("up.net", "/d", None, "block"),
    22: ("go.net", "/x", None, "allow"),
    23: ("slow.net", "/", None, "allow"),
    24: ("q.net", "/s", None, "block"),
    25: ("q.net", "/s", None, "block"),
    26: ("base.net", "/1/2", None, "block"),
    27: ("base.net", "/other/z", None, "block"),
    28: ("mail.net", "/", None, "allow"),
    29: ("self.net", "/p", None, "allow"),
    None: ("bad.com", "/n", "bad.com/", "block"),
}


def judged(spark, pages, redirects=None):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(*p, "x", 1) for p in pages]
    return u.judge(spark.createDataFrame(rows, SCHEMA), rules, redirects)


def test_rules_and_aliases(spark):
    redirects = spark.createDataFrame([("http://moved.net/old", "https://bad.com/new"), (None, "http://bad.com/"), ("", "")], "from_url string, to_url string")
    got = judged(spark, PAGES, redirects).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert tuple(r)[1:] == WANT[r["page_id"]], r


def test_many_rules_are_joined(spark, monkeypatch):
    whole = sorted(map(str, judged(spark, PAGES).collect()))
    monkeypatch.setattr(u, "SENT_RULES", 0)
    assert sorted(map(str, judged(spark, PAGES).collect())) == whole


def test_dots(spark):
    paths = {"/a/./b": "/a/b", "/a/b/..": "/a/", "/../x": "/x", "/a/../../x/": "/x/", "/a/.": "/a/", "/.well": "/.well", "/a?x=/../b": "/a?x=/../b", "/p.q/./r?y": "/p.q/r?y"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["q"] for r in rows.select("p", u.without_dots(F.col("p")).alias("q")).collect()} == paths


def test_hubs_and_chains(spark):
    """100,000 planted edges: hubs of thousands of aliases and chains of hundreds, against a plain version."""
    rng = random.Random(6)
    url = lambda i: f"http://s{i % 997}.net/p/{i}"
    edges, special = [], {}
    for hub in range(20):
        edges += [(hub, 1000 + hub * 4000 + k) for k in range(4000)]
    for chain in range(40):
        first = 90_000 + chain * 500
        edges += [(first + k, first + k + 1) for k in range(499)]
        special[first + rng.randrange(500)] = "http://bad.com/c"
        if chain % 4 == 0:
            special[first + rng.randrange(500)] = "http://a.org/ok"
    special |= {1000 + hub * 4000 + 17: "http://bad.com/h" for hub in range(0, 20, 2)}
    name = lambda i: special.get(i, url(i))
    ends = [(name(a), name(b)) for a, b in edges]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in ends:
        up[root(a)] = root(b)
    rule = lambda x: "block" if x.startswith("http://bad.com/") else "allow" if x.startswith("http://a.org/") else None
    bad, good = ({root(x) for x in up if rule(x) == v} for v in ("block", "allow"))
    want = {x: rule(x) or ("block" if root(x) in bad - good else "allow") for x in up}
    by = {x: i for i, x in enumerate(sorted(up))}
    pages = spark.createDataFrame([(i, x, None) for x, i in by.items()], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = u.judge(pages, rules, spark.createDataFrame(ends, "from_url string, to_url string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: want[x] for x, i in by.items()}
    assert 10_000 < sum(v == "block" for v in want.values()) < len(want) - 10_000


def test_without_pages_or_links(spark):
    assert judged(spark, []).count() == 0
    assert {r["verdict"] for r in judged(spark, [(1, "http://a.net/", None)]).collect()} == {"allow"}


def test_native_plan(spark):
    plan = queries.QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    same(queries.QUERIES["op7_url_filter"](spark, folder), queries.SQL["op7_url_filter"], connect(folder))


@pytest.mark.parametrize("head, verdict", [
    ('<!-- <link rel="canonical" href="http://bad.com/"> -->', "allow"),
    ('<script>var x = \'<link rel="canonical" href="http://bad.com/">\';</script >', "allow"),
    ('<style>/* <link rel=canonical href="http://bad.com/"> */</style>', "allow"),
    ('<!-- open <link rel="canonical" href="http://bad.com/">', "allow"),
    ('<script>1</script><link rel="nofollow canonical" href="http://bad.com/">', "block"),
    ("<LINK href='http://bad.com/' REL='Canonical nofollow'>", "block"),
    ("<link rel=canonical href=http://bad.com/>", "block"),
    ('<link rel="canonical-not" href="http://bad.com/">', "allow"),
    ('<link data-rel="canonical" href="http://bad.com/">', "allow"),
])
def test_tags_that_count(spark, head, verdict):
    got = judged(spark, [(1, "http://own.net/", f"<html>{head}<p>x canonical")])
    assert [r["verdict"] for r in got.collect()] == [verdict]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT 1 AS page_id, 'http://own.net/' AS url, ? AS html", [f"<html>{head}<p>x canonical".replace("bad.com/", "e.com/de/")])
    assert c.execute(queries.SQL["op7_url_filter"]).df()["verdict"].tolist() == [verdict]
