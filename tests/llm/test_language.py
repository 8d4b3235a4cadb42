import zlib

import numpy as np

from larkfield.llm import language


def test_gradients_match_differences():
    """Backpropagation through time against numerical derivatives."""
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    n = np.array([6, 5, 3])
    x = rng.integers(1, 256, (6, 3))
    label = np.array([0, 2, 1])

    def loss():
        p = net._both(x, language._live(n, 6))
        live = np.arange(6)[:, None] < n[None, :]
        return -(np.log(p[:, label, np.arange(3)]) * live).sum() / n.sum()

    g = net.gradients(x, n, label)
    for k, w in net.w.items():
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, w.shape)
            keep, eps = w[at], 1e-5
            w[at] = keep + eps
            up = loss()
            w[at] = keep - eps
            down = loss()
            w[at] = keep
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3, k


def test_held_out_accuracy(spark):
    from larkfield.llm import registry
    from larkfield.runtime import read_table

    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op2_language_id"](spark, sf).join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([
        ("the and of that with this from " * 9, "en"), ("der die und nicht mit auf ein " * 9, "de"), ("the of and to in that is " * 5, "en"), ("und der die das von zu den " * 5, "de"),
        (None, "en"), ("", None), ("123 --- 456", "de"), ("Ω", None), ("the " * 30_000, "en"), ("x" * 5000, "de"), ("die und der", None),
    ])]
    rows += [rows[0], (None, "und die der", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    net = language.train(df, "doc_id", "text", "lang", language.held_out().isNotNull())
    out = language.identify(df, net)
    assert out.columns[-1] == "language_1" and out.count() == len(rows)
    got = {(r.doc_id, r.text): r.language_1 for r in out.collect()}
    assert {got[k].lang for k in got if k[1] is None or k[1] in ("", "123 --- 456")} == {"und"}
    assert got[(10, "die und der")].lang == "de" and got[(8, "the " * 30_000)].lang == "en"
    assert got[(7, "Ω")].lang in ("en", "de")
    none = spark.createDataFrame([], df.schema)
    assert language.train(none, "doc_id", "text", "lang", language.held_out()) is None
    assert language.identify(none, None).collect() == []
    assert {r.language_1.lang for r in language.identify(df, None).collect()} == {"und"}


def plain(net, raw):
    """The network as its definition says: byte after byte of one text, in both directions."""
    h = language.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    x = language._TABLE[raw]
    states = {}
    for d in "fb":
        s, out, u = np.zeros(h), np.zeros((len(x), h)), net.w[d + "u"].astype(float)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = net.w[d + "x"][:, x[t]].astype(float)
            z, r = sigmoid(a[:h] + u[:h] @ s), sigmoid(a[h : 2 * h] + u[h : 2 * h] @ s)
            n = np.tanh(a[2 * h :] + r * (u[2 * h :] @ s))
            s = s + z * (n - s)
            out[t] = s
        states[d] = out
    e = np.exp(np.concatenate([states["f"], states["b"]], 1) @ net.w["o"].T + net.w["c"][:, 0])
    return (e / e.sum(1, keepdims=True)).mean(0)


def test_every_position_counts_as_the_definition_says():
    """Texts that fit a window against the plain recurrences; the states cross blanks. Longer texts against their windows."""
    import pyarrow as pa

    from larkfield.llm import kernels

    net = language.Network(["a", "b"])
    texts = ["one two one " + "z" * 100, "two", "", "\u65e5\u672c \u00e9" * 9, "ab " * 700]
    raw, offsets = kernels.string_views(pa.array(texts))
    got = net.pooled(raw, offsets)
    for k in (0, 1, 3):
        assert np.abs(got[k] - plain(net, raw[offsets[k] : offsets[k + 1]])).max() < 1e-5
    assert got[2].sum() == 0
    long = raw[offsets[4] :]
    want, step, c = 0, language.STEP, language.CONTEXT
    lo, n, before, own, text = language.windows(np.array([0, len(long)]))
    assert own.sum() == len(long) == (lo + before + own)[-1] and set(text) == {0} and before[1] == c
    for k in range(len(lo)):
        piece = long[lo[k] : lo[k] + n[k]]
        p = net._both(language._TABLE[piece].astype(int)[:, None], np.ones(n[k], int))[:, :, 0]
        want = want + p[before[k] : before[k] + own[k]].sum(0)
    assert np.abs(got[4] - want / len(long)).max() < 1e-5
    alone = net.pooled(raw[offsets[1] : offsets[2]], np.array([0, offsets[2] - offsets[1]]))
    assert np.round(alone[0], 6).tolist() == np.round(got[1], 6).tolist()


def test_the_sample_is_bounded_and_of_distinct_texts(spark, monkeypatch):
    """The network is fitted on TRAIN_DOCS distinct texts, of each a piece of TRAIN_PIECE characters at most, however often one of them occurs."""
    df = spark.createDataFrame([(k, f"only{k}", "en") for k in range(9)] + [(20, "y" * 90, "de"), (21, "z", "de")], "doc_id long, text string, lang string")
    df = df.unionByName(df).unionByName(df.where("doc_id = 0"))
    rows = df.withColumn("h", language.F.xxhash64("text"))
    assert len(language._sample(rows)) == 11
    monkeypatch.setattr(language, "TRAIN_DOCS", 4)
    got = language._sample(rows)
    assert len(got) == len(set(got)) == 6
    monkeypatch.setattr(language, "TRAIN_PIECE", 50)
    assert all(len(t) <= 50 for _, t in language._sample(rows))


def test_the_least_probability_follows_the_number_of_languages(spark):
    df = spark.createDataFrame([(k, f"the words {k} of it", "en") for k in range(8)], "doc_id long, text string, lang string")
    assert language.train(df, "doc_id", "text", "lang", language.F.lit(True)).least <= 1
    two = df.unionByName(spark.createDataFrame([(k, f"und das {k} wort ist", "de") for k in range(20, 28)], df.schema))
    assert 0.5 < language.train(two, "doc_id", "text", "lang", language.F.lit(True)).least < 0.65


def test_a_long_text_leaves_no_other_out(spark):
    """One text of five megabytes, of the least hash of its language, takes one place of the sample and no more."""
    short = [("en", f"a short text {i}") for i in range(20)] + [("de", f"ein kurzer Text {i}") for i in range(20)]
    df = spark.createDataFrame([*short, ("en", "long words of one text " * 250_000)], "lang string, text string")
    rows = df.selectExpr("lang", "text", "CASE WHEN length(text) > 1000 THEN 1L ELSE xxhash64(text) END AS h")
    got = language._sample(rows)
    assert len(got) == 41 and {t for _, t in got} >= {t for _, t in short}
    assert max(len(t) for _, t in got) == language.TRAIN_PIECE and sum(len(t.encode()) for _, t in got) < 2 * language.TRAIN_BYTES
