import random
import re

from larkfield.llm import url_filter as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match("[^?#]*", rest[len(host):])[0]


def rule(url, rules):
    host, path = split(url)
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def node(url):
    host, _ = split(url)
    rest = url.split("://", 1)[1]
    return host + rest[len(host):].split("#")[0]


def brute(pages, links, rules):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for a, b in links if a and b and "://" in a and "://" in b]
    for a, b in links:
        root[find(node(a))] = find(node(b))
    bad = {find(node(x)) for a, b in links for x in (a, b) if rule(x, rules)[1] == "block"}
    out = []
    for i, url in pages:
        name, verdict = rule(url, rules)
        alias = url and "://" in url and node(url) in root and find(node(url)) in bad
        out.append((i, *split(url), name, verdict or ("block" if alias else "allow")))
    return sorted(map(str, out))


def test_same_as_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.com", "B.example.COM", "example.net", "x.example.net", "notexample.net", "spam.net", "z.org", "q.Org", "é.com"]
    url = lambda: f"http{rng.choice(('', 's'))}://{rng.choice(hosts)}{rng.choice(('', '/', '/de/1', '/en/2', '/fr/3', '/fr', '?q=/de/', '#/de/', '/en/2#x', '/de/1?a=b'))}"
    pages = [(i, url()) for i in range(150)] + [(500, None), (501, ""), (502, "no scheme/de/"), (503, "://"), (504, "x://y://z.net/"), (505, "http://a.com/" + "p" * 50_000), (500, None)]
    links = [(rng.choice(pages)[1], rng.choice(pages)[1] if rng.random() < 0.5 else url()) for _ in range(40)] + [(None, "http://a.com"), ("http://a.com", None), ("http://a.com/", "http://a.com/")]
    p = spark.createDataFrame([(*r, "y") for r in pages], "page_id long, url string, url_verdict string")
    out = u.judge_urls(p, html_col=None, redirects=spark.createDataFrame(links, "source string, target string"))
    assert out.columns[-1] == "url_verdict_1"
    got = sorted(str((r.page_id, *r.url_verdict_1)) for r in out.collect())
    assert got == brute(pages, links, u.RULES)


def test_links_in_html(spark):
    pages = [
        (1, "http://a.com/1", '<link rel="canonical" href="http://spam.net/x">'), (2, "http://a.com/2", "<LINK href='/1' rel=canonical>"),
        (3, "http://a.com/3", '<meta http-equiv="refresh" content="0; url=http://a.com/2">'), (4, "http://a.com/4", '<a href="http://spam.net/x">'),
        (5, "http://example.net/en/5", '<link rel="canonical" href="//spam.net/x">'), (6, "http://a.com/6", None), (7, None, '<link rel="canonical" href="/z">'),
    ]
    out = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.url_verdict.verdict for r in out.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_empty(spark):
    assert u.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_links_resolve_as_browsers_do(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    bases = ["http://h.com/a/x.html", "https://H.com", "http://h.com?q=1", "http://h.com/a/b/../c/?x=/y#z"]
    targets = ["y.html", "../y", "./y/", "../../../y", "/a/../b", "?p=2", "#top", "//other.org/x", "https://o.org/./k", "y?a=../b", "..", ".", "a/b/c", "y&amp;z", "mailto:x@y"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    for r in df.select("b", "t", u.resolve(F.col("b"), F.col("t")).alias("r")).collect():
        want = urljoin(r.b.replace("H.com", "h.com"), r.t.replace("&amp;", "&"))
        assert r.r.split("#")[0].replace("H.com", "h.com").rstrip("/") == want.split("#")[0].rstrip("/"), (r.b, r.t, r.r, want)


def test_relative_links_block_and_sql_agrees(spark):
    import duckdb

    pages = [
        (1, "http://h.com/a/x.html", '<link rel="canonical" href="y.html">'), (2, "http://spam.net/b", '<link rel="canonical" href="http://h.com/a/y.html">'),
        (3, "http://h.com/a/b/z", '<link rel=canonical href="../y.html">'), (4, "http://h.com/q", '<meta http-equiv=refresh content="0; url=?k=1&amp;l=2">'),
        (5, "http://h.com/q?k=1&l=2", '<link rel="canonical" href="//spam.net/b">'), (6, "http://k.com", '<link rel="canonical" href="a/./b/..">'), (7, "http://k.com/a/", None), (8, "http://k.com/c", '<link rel="canonical" href="#">'),
    ]
    out = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r.url_verdict.verdict for r in out.collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert {r[0]: r[4] for r in con.execute(u.OP10_SQL).fetchall()} == got
