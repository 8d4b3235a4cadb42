import math

import numpy as np
import pyarrow as pa
import pytest

from larkfield.llm import kernels, lm_score as lm
from larkfield.runtime import Scratch

ROWS = [(1, "the cat sat on the mat the end"), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "a b " * 20_000), (7, "the cat sat on the mat the end"), (None, "the dog")]


def parts(text):
    raw, offsets = kernels.string_views(pa.array([text], pa.string()))
    h, begin, end, first = kernels.hash_words(raw, offsets, kernels.SPACE_WORDS)
    return h, lm.ending(raw, begin, end) if len(h) else np.zeros(0, np.int64), first


def network(v, weights, text):
    """log P(symbol | both sides) of every token, one at a time, as the definition says."""
    h, kinds, _ = parts(text)
    symbols, *_ = v.encode(h, kinds)
    out = []
    for t in range(len(h)):
        near = [symbols[t + k] if 0 <= t + k < len(h) else v.pad for k in (-3, -2, -1, 1, 2, 3)]
        hidden = np.tanh(np.concatenate([weights["v"][s] for s in near]).astype(float) @ weights["m"] + weights["b"])
        z = hidden @ weights["o"] + weights["c"]
        c = v.cls[symbols[t]]
        lo, hi = v.begin[c], v.begin[c + 1]
        y = weights["u"][lo:hi] @ hidden + weights["p"][lo:hi]
        out.append(z[c] - np.log(np.exp(z).sum()) + y[symbols[t] - lo] - np.log(np.exp(y).sum()))
    return np.array(out)


def small(monkeypatch, listed=50, counted=50):
    monkeypatch.setattr(lm, "LISTED", listed)
    monkeypatch.setattr(lm, "COUNTED", counted)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 300).astype(np.uint64)
    v = lm.Vocabulary(words, np.arange(300, 0, -1), rng.integers(0, lm.ENDINGS, 300), np.full(lm.ENDINGS, 9000.0))
    w = {k: rng.normal(0, 0.2, x.shape) + x for k, x in lm.start(v).items()}
    x, y = rng.integers(0, v.pad + 1, (60, 2 * lm.SIDE)), rng.integers(0, v.pad, 60)

    def loss():
        hidden = np.tanh(w["v"][x].reshape(60, -1) @ w["m"] + w["b"])
        return -lm.log_probabilities(w, v, hidden, y).mean()

    for k, grad in lm.gradients(w, v, x, y).items():
        if k == "v":
            rows, part = grad
            grad = np.zeros_like(w["v"])
            grad[rows] = part
        for i in np.argsort(-np.abs(grad).ravel())[:3]:
            at = np.unravel_index(i, grad.shape)
            keep, eps = w[k][at], 1e-5
            w[k][at] = keep + eps
            up = loss()
            w[k][at] = keep - eps
            down = loss()
            w[k][at] = keep
            assert abs((up - down) / (2 * eps) - grad[at]) < 1e-4, k


@pytest.mark.parametrize("listed,counted", [(8192, 1 << 19), (20, 60), (20, 20)])
def test_scores_are_those_of_the_definition(spark, monkeypatch, listed, counted):
    """Every token by hand from its six neighbours, and every word that isn't listed by its own count, with or without a join."""
    small(monkeypatch, listed, counted)
    texts = [" ".join(f"w{j}" for j in range(200) for _ in range(1 + (j % 7 == k) + (j > 190))) for k in range(6)] + ["w1 w2 rare", "rare w3 w3"]
    rows = ROWS[:5] + [(10 + k, t) for k, t in enumerate(texts)] + [(10, texts[0]), (99, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm._counted(df.select("text"), Scratch(spark, "t"))
    n, kind = {}, {}
    for r in counts.collect():
        n[r.word], kind[r.word] = r.n, r.ending
    v = lm._listed(counts)
    order = sorted(n, key=lambda w: (-n[w], w))
    assert v.lookup.keys[:-1].view(np.int64).tolist() == order[:counted]
    rest = np.zeros(lm.ENDINGS)
    for w in order[listed:]:
        rest[kind[w]] += n[w]
    weights = lm.train(df.select("text"), v)
    monkeypatch.setattr(lm, "train", lambda texts, vocabulary: weights)
    got = [(r.doc_id, r.lm.log_prob, r.lm.n_tokens) for r in lm.score_documents(df).collect()]
    assert len(got) == len(rows)
    for i, p, tokens in got:
        text = dict(rows)[i] or ""
        h, _, _ = parts(text)
        own = sum(math.log(n[w] / rest[kind[w]]) for w in h.view(np.int64).tolist() if w not in order[:listed])
        assert tokens == len(h) and abs(p - network(v, weights, text).sum() - own) < 0.05


def test_all_words_add_up_to_one():
    rng = np.random.default_rng(1)
    words, kinds, counts = rng.integers(0, 2**63, 90).astype(np.uint64), rng.integers(0, lm.ENDINGS, 90), np.sort(rng.integers(1, 50, 90))[::-1]
    totals = np.bincount(kinds, counts, lm.ENDINGS)
    for listed in (10, 90):
        keep, lm.LISTED = lm.LISTED, listed
        try:
            v = lm.Vocabulary(words, counts, kinds, totals)
        finally:
            lm.LISTED = keep
        w = {k: (rng.normal(0, 0.2, x.shape) + x).astype(np.float32) for k, x in lm.start(v).items()}
        hidden = np.tanh(rng.normal(0, 1, (1, lm.HIDDEN))).astype(np.float32)
        symbols, share, missing = v.encode(words, kinds)
        p = lm.log_probabilities(w, v, np.repeat(hidden, 90, 0), symbols) + share
        # kinds without unlisted words have a symbol too, of half a token at most
        empty = [s for k, s in enumerate(v.rest) if not any(kinds[listed:] == k)]
        more = np.exp(lm.log_probabilities(w, v, np.repeat(hidden, len(empty), 0), np.array(empty, int))).sum() if empty else 0
        assert abs(np.exp(p).sum() + more - 1) < 1e-4 and not missing.any()


def test_lookup_finds_all_keys_and_no_others():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64) & np.uint64(0xFF00000000FFFFFF))  # many share their first bits
    table = lm.Lookup(keys)
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert (table.find(keys + np.uint64(1 << 40)) == -1).all()
    assert (lm.Lookup(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lm string")
    out = lm.score_documents(df)
    assert out.columns[-1] == "lm_1"
    got = {r.doc_id: r.lm_1 for r in out.collect()}
    assert len(got) == len(ROWS) and got[1] == got[7] and got[6].n_tokens == 40_000
    for k in (2, 3, 4):
        assert (got[k].n_tokens, got[k].log_prob, got[k].per_token) == (0, 0.0, None)
    assert all(got[k].log_prob < 0 for k in (1, 5, 6, None))
    assert lm.score_documents(spark.createDataFrame([], df.schema)).collect() == []


def test_training_helps_on_texts_it_has_not_seen(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    seen, unseen = df.where("doc_id % 5 > 0").select("text"), df.where("doc_id % 5 = 0").limit(80).collect()
    v = lm.count_words(df.select("text"), Scratch(spark, "t"))
    trained, fresh = lm.train(seen, v), lm.start(v)
    mean = lambda w: np.concatenate([network(v, w, r.text[:4000]) for r in unseen]).mean()
    assert mean(trained) > mean(fresh) + 0.15


def test_every_document_trains(spark, monkeypatch):
    """Whatever their hashes, all tokens of all rows may be masked, copies included; with one in one, all are predicted."""
    monkeypatch.setattr(lm, "MASK", 1)
    df = spark.range(40).selectExpr("concat('word', id, ' and then some') AS text").limit(5)
    df = df.unionByName(df.limit(1))
    v = lm.count_words(df, Scratch(spark, "t"))
    got = pa.Table.from_batches(lm._local_training(v, lm.start(v), 0)(iter(df.toArrow().to_batches())))
    assert set(got.column("seen").to_pylist()) == {24.0}
    trained, fresh = lm.train(df, v), lm.start(v)
    assert all(np.abs(trained[k] - fresh[k]).max() > 0.005 for k in "oc")  # one step: the others follow these


def test_garbled_text_scores_below_what_it_was_made_of(spark):
    """Documents of the table against themselves with their words in another order: the same words, so only contexts tell."""
    rng = np.random.default_rng(0)
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and len(r.text.split()) > 60]
    texts = ["the cat sat on the mat and the dog lay by the door " * 6, "a man and a woman went to the sea in a boat " * 6] * 150
    garbled = [" ".join(rng.permutation(t.split())) for t in texts[:2]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + garbled)] + [(10_000 + r.doc_id, r.text) for r in docs[:200]], "doc_id long, text string")
    got = {r.doc_id: r.lm.per_token for r in lm.score_documents(df).collect()}
    assert got[0] > got[300] + 0.2 and got[1] > got[301] + 0.2


def test_context_chooses_among_words_of_one_kind(spark):
    """Two words of like frequency: the one that fits its neighbours is likelier."""
    texts = ["so it is and was and will be " * 2 + ("redding kaffing sunning " if k % 2 else "bluding kuffing mooning ") * 2 for k in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    v = lm.count_words(df, Scratch(spark, "t"))
    weights = lm.train(df, v)
    fits, swapped = "redding kaffing sunning redding kaffing sunning", "redding kuffing sunning redding kuffing sunning"
    assert network(v, weights, fits).sum() > network(v, weights, swapped).sum() + 2
