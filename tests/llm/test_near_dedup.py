import random
import re

import pytest

from larkfield.llm import near_dedup

SCHEMA = "doc_id long, text string, cid string, sig int, component_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i is None or j is None or not a or not b:
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


def corpus(seed, n=140):
    """Copies of copies that drift away from each other, exact copies, short texts and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    pool = [[word() for _ in range(80)]]
    for _ in range(n // 2):
        w = list(rng.choice(pool))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = word()
        pool.append(w)
    pool += [[word() for _ in range(rng.choice((1, 3, 5, 60)))] for _ in range(n // 2)]
    texts = [" ".join(w) for w in pool]
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, percent):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return near_dedup.near_duplicates(df, percent=percent).collect()


@pytest.mark.parametrize("percent,block,sets", [(85, 4096, 512), (80, 16, 8)])
def test_same_as_brute_force(spark, monkeypatch, percent, block, sets):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SETS", sets)
    rows = corpus(percent)
    got = run(spark, rows, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got}) < len(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One Two"), (5, "one two"), (6, "one two three"), (7, long), (8, long + " tail"),
        (9, "a b c d e f g"), (9, "a b c d e f g"), (9, "other words that are not the same"), (10, "other words that are not the same"),
        (None, "a b c d e f g"), (None, None),
    ]
    got = {}
    for r in run(spark, rows, 85):
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[2][:0] + [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] and got[6] == [(1, 6, True)]
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False)
    assert {c for _, c, _ in got[9]} == {9} and all(k for *_, k in got[9]) and got[10] == [(3, 9, False)]
    assert all(c is None and k for _, c, k in got[None])


def test_repeated_ids_and_null_ids_among_copies(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a + " z"), (None, "only nulls " + b[:200]), (None, "only nulls " + b[:204])]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in run(spark, rows, 85) if r.doc_id)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert all(r.kept and r.component_id is None for r in run(spark, rows, 85) if r.doc_id is None)


def test_empty(spark):
    assert run(spark, [], 85) == []


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_guaranteed_distance(percent):
    """Pigeonhole: whatever symbols differ, under the limit some chunk has one error at most, so a pair has a key in common."""
    import numpy as np

    limit = near_dedup.most_distance(percent)
    cut = near_dedup.chunks(limit)
    assert sum(size for _, size in cut) == near_dedup.SYMBOLS and [at for at, _ in cut] == list(np.cumsum([0] + [n for _, n in cut])[:-1])
    rng = np.random.default_rng(3)
    for _ in range(2000):
        differ = np.zeros(near_dedup.SYMBOLS, bool)
        differ[rng.choice(near_dedup.SYMBOLS, limit, replace=False)] = True
        assert min(differ[at : at + size].sum() for at, size in cut) <= 1


def test_a_large_family_moves_few_rows(spark, monkeypatch):
    """A key of many blocks: rows grow with the members, and the result is that of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SETS", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    first, second = [word() for _ in range(90)], [word() for _ in range(90)]
    second[:70] = first[:70]  # near by signature, but no link
    texts = []
    for base in (first, second):
        for _ in range(60):
            w = list(base)
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, rows, 80)} == brute(rows, 80)
    members = spark.range(400).selectExpr("id AS cid", "1L AS key", "400L AS members")
    units = near_dedup._in_blocks(members, "key", near_dedup.F.expr("cid < 16"), near_dedup.F.lit(16), near_dedup.F.lit(384), 16)
    assert units.count() <= 400 + 16 * 25
