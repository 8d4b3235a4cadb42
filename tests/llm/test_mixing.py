import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from larkfield.llm import mixing


def share_out(budget, nodes):
    """Water level by repeated capping: nodes are (name, weight, cap)."""
    got, live = {}, {n: (w, c) for n, w, c in nodes if w > 0 and c > 0}
    left = budget
    while live:
        level = left / sum(w for w, _ in live.values())
        full = {n: c for n, (w, c) in live.items() if c <= level * w}
        if not full:
            got |= {n: int(level * w) for n, (w, _) in live.items()}
            break
        got |= full
        left -= sum(full.values())
        live = {n: x for n, x in live.items() if n not in full}
    return got


def brute(rows, share, epochs, weights, seed):
    data = []
    for i, t, lang, source in rows:
        m = re.search("([0-9]{1,9})$", source or "")
        data.append((i, f"d{int(m[1]) % 4}" if m else "other", lang or "other", source or "other", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    supply = {}
    for _, *leaf, n in data:
        supply[tuple(leaf)] = supply.get(tuple(leaf), 0) + n
    cap = lambda *prefix: sum(epochs * n for k, n in supply.items() if k[: len(prefix)] == prefix)
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    plan = {}
    domains = share_out(int(sum(supply.values()) * share), [(d, w("domain", d), cap(d)) for d in sorted({k[0] for k in supply})])
    for d, b in domains.items():
        langs = share_out(b, [(x, w("lang", x), cap(d, x)) for x in sorted({k[1] for k in supply if k[0] == d})])
        for x, c in langs.items():
            for s, g in share_out(c, [(s, w("source", s), cap(d, x, s)) for s in sorted({k[2] for k in supply if k[:2] == (d, x)})]).items():
                plan[(d, x, s)] = g
    out = []
    for leaf in supply:
        own = [r for r in data if tuple(r[1:4]) == leaf]
        full, rest = divmod(plan.get(leaf, 0), supply[leaf]) if supply[leaf] else (0, 0)
        key = lambda r: hashlib.md5(":".join([str(seed), *([str(full)] if plan.get(leaf) is not None else []), *([] if r[0] is None else [str(r[0])])]).encode()).hexdigest()  # noqa: B023, E731
        for r in sorted(own, key=lambda r: (key(r), -1 if r[0] is None else r[0], r[4])):
            take = max(0, min(r[4], rest))
            rest -= take
            out.append((*r, full if r[4] else 0, take))
    return sorted(map(str, out)), plan


def rows(seed):
    rng = random.Random(seed)
    out = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice((1, 5, 40)))), rng.choice(("en", "en", "de", "fr", None)), rng.choice(("src0", "src0", "src0", "src1", "src2", "src7", "web", None))) for i in range(300)]
    return out + [(900, None, "en", "src0"), (901, " \n", "en", "src3"), (902, "x " * 3000, "de", "src1"), (5, out[5][1], out[5][2], out[5][3]), (None, "a b c", "en", "src9")]


@pytest.mark.parametrize("share,epochs", [(1.0, 2), (0.3, 1), (5.0, 3), (0.0, 2)])
def test_same_as_brute_force(spark, share, epochs):
    weights = {"domain": {"d0": 4, "d1": 1, "other": 0.5}, "lang": {"en": 3}, "source": {"web": 2}}
    data = rows(epochs)
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, source string, n_tokens int")
    got = mixing.mix(df, share, epochs, weights, 7)
    want, plan = brute(data, share, epochs, weights, 7)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    total = got.select(F.sum(F.col("epochs") * F.col("n_tokens") + F.col("last_tokens"))).first()[0]
    assert total == sum(plan.values())


def test_siblings_before_ancestors(spark):
    """A leaf's shortage goes to its siblings; the other domain keeps its share."""
    rows = [(1, "a " * 10, "en", "x0"), (2, "a " * 100, "en", "x4"), (3, "a " * 110, "en", "y1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.epochs * r.n_tokens + r.last_tokens for r in mixing.mix(df, 0.5, 1, {"source": {"x0": 9}}).collect()}
    assert got == {1: 10, 2: 45, 3: 55}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
