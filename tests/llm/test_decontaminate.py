import hashlib
import random
import re

import numpy as np

from larkfield.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w = words(text)
    hit, found, longest = set(), set(), 0
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    if item is not None:
                        found.add(str(item))
                    k = n
                    while p + k < len(w) and i + k < len(v) and w[p + k] == v[i + k]:
                        k += 1
                    longest = max(longest, k)
    return len(w), len(hit), sorted(found), longest


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "of", "and", "tion", "été", "x1", "Über"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((30, 12, 10, 9, 4, 15))] + [(20, None), (21, "..."), (None, text(14)), (0, text(11)), (5, "")]
    docs = []
    for k in range(60):
        parts = [text(rng.choice((0, 3, 8))) for _ in range(6)]
        v = words(rng.choice(items[:6])[1])
        cut = rng.randrange(len(v))
        parts.insert(3, ", ".join(v[cut : cut + rng.choice((3, 9, 10, 14))]).upper())
        docs.append((k, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "!?"), (103, docs[0][1]), (103, docs[0][1])]
    a = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, match string, lf_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = d.benchmark_matches(a, b)
    assert got.columns == ["doc_id", "text", "match", "lf_hit", "match_1"]
    for r in got.collect():
        m = r.match_1
        ones = int(np.unpackbits(np.frombuffer(m.hit, np.uint8)).sum()) if m.hit else 0
        assert (m.n_words, ones, m["items"], m.longest) == brute(r.text, items), r.doc_id
        assert [x["item"] for x in m.matches] == m["items"]
        for x in m.matches:  # where it says, and no longer
            v = [words(t) for i, t in items if str(i) == x["item"]]
            same = [w[x.item_at :][: x.words] == words(r.text)[x.at :][: x.words] and len(w) >= x.item_at + x.words for w in v]
            assert any(same) and x.words <= m.longest
    kept = {r.doc_id for r in d.decontaminate(a, b).collect()}
    assert kept == {i for i, t in docs if not brute(t, items)[1]}


def test_blocks_and_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(k, text(25)) for k in range(12)]
    docs = [(k, text(20) + " " + items[k % 12][1] + " " + text(20)) for k in range(40)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, d.benchmark_matches(a, b).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 100)
    assert len(list(d.test_blocks(b, "item_id", "text", 10))) > 3
    assert sorted(map(str, d.benchmark_matches(a, b).collect())) == one


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.benchmark_matches(none, items).collect() == []
    r = d.benchmark_matches(some, items).first().match
    assert (r.n_words, r["items"], r.longest) == (2, [], 0)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    depth = 9
    words = np.concatenate([rng.integers(0, 3, 400), np.zeros(depth + 2, np.int64)])
    sa = d.suffix_array(words, np.arange(400), 4, depth)
    # as far as the first 0, that is a word of no item, as it ends every match
    keys = [tuple(words[p : p + depth]) for p in sa]
    keys = [k[: k.index(0) + 1] if 0 in k else k for k in keys]
    assert keys == sorted(keys) and sorted(sa) == list(range(400))


def test_every_test_suffix_gets_its_longest_match():
    rng = random.Random(5)
    text = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = [text(n) for n in (12, 3, 30)]
    test = d.TestSide([1, 2, 3], [" ".join(w) for w in items], 10)
    shard = text(150) + items[2][5:25] + ["unknown"] + text(150)
    raw, offsets = d.kernels.string_views(d.pa.array([" ".join(shard)]))
    h, *_ = d.kernels.hash_words(raw, offsets, d.kernels.ALNUM_WORDS)
    ids = {int(w): k + 1 for k, w in enumerate(test.vocabulary)}
    padded = np.array([ids.get(int(w), 0) for w in h] + [0] * (test.depth + 3), np.int64)
    sa = d.suffix_array(padded, np.arange(len(h) + 1), test.base, test.depth)
    best, where = d.longest_matches(padded, sa, test)
    k = 0
    for item in items:
        for i in range(len(item)):
            want = max(n for n in range(len(item) - i + 1) if any(shard[p : p + n] == item[i : i + n] for p in range(len(shard))))
            assert best[k] == want and shard[where[k] :][:want] == item[i : i + want]
            k += 1


def test_query_digest(spark, sf):
    from larkfield.llm import registry

    rows = registry.QUERIES["op9_decontaminate"](spark, sf).collect()
    clean = next(r for r in rows if not r.contaminated)
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest() and clean.n_hit == 0


def test_items_of_one_text_are_matched_once(spark):
    """5,000 items of one short text against a document that holds it 1,000 times, and equal rows of one item."""
    import time

    from larkfield.llm import decontaminate as d

    docs = spark.createDataFrame([(1, "yes " * 1000), (2, "no")], "doc_id int, text string")
    bench = spark.createDataFrame([(str(i), "yes") for i in range(5000)] + [("0", "yes")] * 5000 + [(None, "yes")], "item_id string, text string")
    test = next(iter(d.test_blocks(bench, "item_id", "text", 10)))
    assert len(test.ids) == 1 and len(test.ids[0]) == 5000 and test.depth == 1
    began = time.time()
    got = {r.doc_id: r.match for r in d.benchmark_matches(docs, bench).collect()}
    assert time.time() - began < 20
    assert got[1]["items"] == sorted(map(str, range(5000))) and got[2]["items"] == [] and got[1]["longest"] == 1
