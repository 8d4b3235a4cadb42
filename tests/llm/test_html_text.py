import math
import random

import pytest

from larkfield.llm import html_text as t

SCHEMA = "page_id long, url string, html string"


def text(page):
    return t.blocks_of(page)[0]


@pytest.mark.parametrize("page, want", [
    ("<nav><ul><li>Home<li>News</ul></nav><article><h1>A &amp; b</h1><p>one<br>two</p><p>x&nbsp; \n y<b>z</b></article><footer>c</footer>", ["A & b", "one two", "x yz"]),
    ("<body><header>Site</header><p>only<div class='ad-slot'>buy</div>rest<aside>side</aside></body>", ["only", "rest"]),
    ("<div class='has-sidebar'><div id=menu>m</div><article><header><h1>T</h1></header>body<section id='comments'><article>mine</article></section></article></div>", ["T", "body"]),
    ("<main><p>main<form>f<input></form></main><p>out", ["main"]),
    ("<p>a &lt;p&gt; b<script>var t='</p>';</script> c<!-- <p>no</p> --><style>p{}</style>d", ["a <p> b cd"]),
    ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><pre> a\n b</pre>", ["one", "two", "1 2", "3", "a b"]),
    ("<article><p class=notice>Cookies<p>kept</article>", ["kept"]),
    ("<article>a<div hidden>h</div><div style='display: none'>n</div><div aria-hidden=true>r</div>b", ["a", "b"]),
    ("<nav>never closed<p>still nav", []),
    ("<div><nav>open</div><p>after", ["after"]),
    ("a < b and c > d &notin; &#x41;&amp", ["a < b and c > d ∉ A&"]),
    ('<a title="x > y">in</a><P>UP</P><ARTICLE><P>Big</ARTICLE>', ["Big"]),
    ("", []), (None, []), ("<p> \n </p>", []), ("plain", ["plain"]), ("<title>t</title><p>b", ["b"]),
    ("<article><section role=navigation>m</section><figure><img><figcaption>cap</figcaption></figure></article>", ["cap"]),
])
def test_blocks(page, want):
    assert text(page) == want


def test_long_pages_take_time_in_line():
    assert len(text("<p>word " * 100_000)) == 100_000
    assert len(text("<b><i>x" * 50_000)[0]) == 50_000
    for odd in ("<div ", "<a '", '<a "', "<!", "<!--", "<nav>", "<script ", "</p>", "<nav><!--", "<i>", "<div hidden>"):
        assert text(odd * 20_000 + "'\"") is not None


def brute(rows):
    """Plain counting of runs, page by page."""
    hosts = {}
    for i, url, page in rows:
        host = url.split("/")[2].lower() if url else ""
        hosts.setdefault(host, []).append((i, *t.blocks_of(page)))
    out = []
    for host, pages in hosts.items():
        stream = lambda b: tuple(f" {t.EDGE} ".join(["", *b, ""]).split(" ")[1:-1]) if b else ()
        runs = lambda s: {s[k : k + t.RUN] for k in range(len(s) - t.RUN + 1)}
        distinct = {stream(b) for _, b, _ in pages if b}
        count = {}
        for s in distinct:
            for r in runs(s):
                count[r] = count.get(r, 0) + 1
        need = lambda rule: max(rule[1], math.ceil(rule[0] * len(distinct) - 1e-9))
        for i, blocks, marked in pages:
            s = stream(blocks)
            covered = [False] * len(s)
            for k in range(len(s) - t.RUN + 1):
                if host and count[s[k : k + t.RUN]] >= need(t.MARKED if marked else t.OPEN):
                    covered[k : k + t.RUN] = [True] * t.RUN
            kept, at, gone, total = [], 1, 0, 0
            for b in blocks:
                n = len(b.split(" "))
                hit = sum(covered[at : at + n])
                if n - hit > t.UNIQUE * n:
                    kept.append(b)
                else:
                    gone += n
                at, total = at + n + 1, total + n
            out.append((i, "\n\n".join(blocks if marked and 2 * gone > total else kept)))
    return sorted(out, key=str)


def site(rng, n, host, marked):
    words = [f"w{k}" for k in range(400)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    notice, menu = say(14), "".join(f"<p>{w}</p>" for w in rng.sample(words, 12))
    shared = say(60)
    rows = []
    for i in range(n):
        body = "".join(f"<p>{say(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 6)))
        body = f"<p>{shared}</p>{body}" if i % 5 == 0 else body
        inner = f"<h1>{say(5)}</h1>{body}<p>{notice}</p>"
        page = f"<body>{menu}<article>{inner}</article>" if marked else f"<body>{menu}<div>{inner}</div>"
        rows.append((f"http://{host}/{i}", page))
    return rows + rows[:2] * 15  # copies count as one page


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_same_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(t, "SHARD_BYTES", shard)
    rng = random.Random(8)
    rows = site(rng, 30, "A.com", True) + site(rng, 25, "b.org", False) + site(rng, 3, "c.org", False) + site(rng, 2, "d.org", False)
    rows += [(None, "<p>no url</p>")] * 5 + [("http://a.com/x", None), ("http://a.com/y", ""), ("http://b.org/z", "<p>" + "long " * 50_000)]
    near = "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=20))}</p>" for _ in range(20))
    rows += [(f"http://near.org/{i}", f"<article>{near}<p>copy number {i}</p></article>") for i in range(8)]  # near copies are articles, no boilerplate
    rows = [(i, *r) for i, r in enumerate(rows)]
    out = t.main_text(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Text string").repartition(5))
    assert out.columns == ["page_id", "url", "Text", "text_1"]
    got = sorted([(r.page_id, r.text_1) for r in out.collect()], key=str)
    want = brute(rows)
    assert got == want
    texts = dict(want)
    assert len(texts[1].split()) < len(" ".join(text(rows[1][2])).split())  # the notice is gone
    assert all(texts[r[0]].count("\n\n") == 20 for r in rows if r[1] and "near" in r[1])


def test_empty(spark):
    assert t.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_array_shows_shared_runs():
    import pyarrow as pa

    shared = "one two three four five six seven eight nine"
    shard = t._Shard(pa.chunked_array([[f"a b {shared} c", f"{shared} d e f", "one two three four five six seven", shared.replace("nine", "ten")]]))
    at, pages = shard.frequent(2)
    assert sorted(pages.tolist()) == [2, 3]
    order, rank = shard.suffixes()
    assert sorted(order.tolist()) == list(range(len(shard.starts))) and (rank[1:] >= rank[:-1]).all()
