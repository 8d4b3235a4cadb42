import re
from collections import Counter

import pytest

from larkfield.llm import line_quality as q


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, line_percent, line_docs, least_left):
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    holders = {}
    for i, t, host in rows:
        for x in lines(t):
            holders.setdefault((host, norm(x)), set()).add(i)
    size = Counter(host for _, host in {((i, t), host) for i, t, host in rows})
    frequent = {(host, x) for (host, x), who in holders.items() if len(who) >= line_docs and 100 * len(who) > line_percent * size[host]}
    out = []
    for i, t, host in rows:
        w = words(t)
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {k + j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(5)}
        dup, seen = 0, set()
        for x in lines(t):
            dup += x in seen
            seen.add(x)
        cut = sum(len(words(x)) for x in lines(t) if (host, norm(x)) in frequent)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        left = "\n".join(x for x in (t or "").split("\n") if (host, norm(x)) not in frequent)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(repeat), cut, failed, not failed and len(w) - cut >= least_left * len(w), left))
    return sorted(map(str, out))


def rows():
    body = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(3))
    out = [(k, f"{body}{k}\nShared  Line here\nown {k}", "h1") for k in range(6)]
    out += [(k, "shared line HERE\n" + " ".join(f"t{k}y{j}" for j in range(3)) + "\nShared line here " * 1, "h1") for k in range(6, 9)]
    out += [(20, None, "h1"), (21, "", None), (22, "a b c d e " * 40, "h2"), (23, "😀 é # * $%& <x>|\n" * 3, "h2"), (24, " ".join(map(str, range(20_000))), "h2")]
    out += [(25, "one two three four five six one two three four five six seven\nShared line here", "h2"), (26, "\n\n \t\n", "h1"), (27, "x y z x y z x y z x", None)]
    out += [(0, out[0][1], "h1"), (30, body + "\nShared line here", None), (31, body, None), (None, "Shared line here", "h1")]
    return out


@pytest.mark.parametrize("line_percent,line_docs", [(5, 5), (40, 2), (90, 1)])
def test_same_as_brute_force(spark, line_percent, line_docs):
    df = spark.createDataFrame([(i, t, h, 1) for i, t, h in rows()], "doc_id long, text string, source string, quality int")
    out = q.line_quality(df, line_percent=line_percent, line_docs=line_docs, least_left=0.3, with_left=True)
    assert out.columns[-1] == "quality_1"
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_cut", "base_failed", "kept", "left")
    got = sorted(str((r.doc_id, *(r.quality_1[f] for f in fields))) for r in out.collect())
    assert got == brute(rows(), line_percent, line_docs, 0.3)


def test_the_limit_is_a_share_at_every_size(spark):
    """The same footer on a tenth of the documents goes from a host of 60 and from one of 600; a rare one stays."""
    text = lambda k, n: "\n".join([f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k}"] + ["the footer"] * (k % 10 == 0) + ["rare one"] * (k in (1, 2)))
    for n in (60, 600):
        df = spark.createDataFrame([(k, text(k, n), "h") for k in range(n)], "doc_id long, text string, source string")
        cut = {r.doc_id: r.quality.n_cut for r in q.line_quality(df).collect()}
        assert all((c == 2) == (k % 10 == 0) for k, c in cut.items())


def test_empty(spark):
    assert q.line_quality(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_native_plan(spark, sf):
    from larkfield.llm import registry

    plan = registry.QUERIES["op4_line_quality"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    moved = [x for x in plan.split("Exchange ")[1:] if re.search(r"\btext#\d+", x.split("\n")[0])]
    assert not moved and "collect_set" not in plan
    for line in re.findall(r"Project \[([^\]]*)\]\n[^\n]*Exchange", plan):
        assert "text#" not in line
