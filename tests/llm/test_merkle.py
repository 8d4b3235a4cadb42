import hashlib
import random
import zlib

import pytest

from larkfield.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    out = []
    for level in tree[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else "", at & 1))
        at >>= 1
    return out


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {name: levels([leaf(r) for r in trees[name]]) for name in names}
    top = levels([built[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(trees[name]):
            steps = way(built[name], i) + way(top, k)
            folded = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for other, left in steps:
                folded = h(other + folded if left else folded + other)
            out.append((r[0], leaf(r), built[name][-1][0], top[-1][0], h("".join(s for s, _ in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


def got(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    out = merkle.sealed(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 256, None: 1}, {"en": 257, "de": 2, "": 3, "é": 5, None: 4}, {"a": 700, "z": 30, **{f"l{i}": 1 for i in range(300)}}])
def test_same_as_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = [(rng.choice([i, i, i, None]), rng.choice(["s", None, ""]), lang, rng.choice([5, -1, None]), rng.choice(["x", "ü" * 9, "", None])) for lang, n in sizes.items() for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_copies_and_long_texts(spark):
    rows = [(1, "s", "en", 3, "same")] * 40 + [(i, None, "en", 3, "long " * 20_000) for i in range(30)] + [(None, None, None, None, None)] * 3
    assert got(spark, rows) == brute(rows)


def test_ways_lead_to_the_tops(spark):
    tree = levels([h(str(i)) for i in range(600)])
    leaves = [("t", i, 600, h(str(i)), i) for i in range(600)] + [("u", 0, 1, h("u"), 0)]
    forest = merkle.Forest(spark.sparkContext.parallelize(leaves, 3), 601, 600, 4)
    assert dict(forest.tops.collect()) == {"t": tree[-1][0], "u": h("u")}
    down = forest.down(forest.tops.mapValues(lambda t: (t, []))).collect()
    assert len(down) == 601 and all(merkle.fold(x[2], x[5]) == x[4] for x in down)


def test_empty(spark):
    assert merkle.sealed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_supersteps_have_bounded_vertices(spark):
    """A tree of a million nodes takes three supersteps; no vertex gets more than its share of messages."""
    n = 70_000
    leaves = spark.sparkContext.range(n, numSlices=4).map(lambda i: ("t", i, n, merkle.digest(str(i)), None))
    forest = merkle.Forest(leaves, n, n, 4)
    assert len(forest.steps) == 3
    assert max(forest.steps[0].map(lambda v: len(v[1])).collect()) == merkle.FAN
    assert forest.tops.collect() == [("t", levels([h(str(i)) for i in range(n)])[-1][0])]
