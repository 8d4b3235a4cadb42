import pytest
from pyspark.sql import functions as F

from larkfield.functions import parse, text as tx, vector


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("番茄叶斑", ["番", "茄", "叶", "斑", "番茄", "茄叶", "叶斑"]), ("The Leaf-Spot of EC 2.5", ["leaf", "spot", "ec", "2", "5"]), ("", []), (None, []),
    ("棚A内b", ["棚", "内", "b"]), ("café del", ["caf", "del"]), ("a the of", []), ("水 分", ["水", "分"]),
])
def test_tokens(spark, raw, want):
    assert one(spark, raw, tx.tokenize) == want


def test_normalize(spark):
    rows = ["ＥＣ　２．５", "  A　B\tc ", None, "ﬁ"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r.r for r in df.select(tx.normalize(F.col("v")).alias("r")).collect()] == ["ec 2.5", "a b c", "", "fi"]
    assert one(spark, "  A　B\tc ", tx.normalize) == "a b c"


def test_query_terms_drop_fillers(spark):
    assert one(spark, "请问番茄叶霉病的防治方法", tx.query_terms) == [t for t in one(spark, "番茄叶霉病", tx.tokenize) if len(t) >= 2]
    assert one(spark, "please help control tomato disease x", tx.query_terms) == ["tomato"]
    assert one(spark, "管理 防治 方法", tx.query_terms) == []


def test_chunks():
    assert tx.chunks("short") == ["short"] and tx.chunks("  ") == [] and tx.chunks(None) == []
    text = "。".join(f"句子{i}" + "字" * 20 for i in range(40)) + "。"
    parts = tx.chunks(text, 100, 20)
    assert all(len(p) <= 120 for p in parts)
    assert all(b.startswith(a[-20:]) for a, b in zip(parts, parts[1:]))
    hard = tx.chunks("x" * 1000, 100, 20)
    assert [len(p) for p in hard][:3] == [100, 100, 100] and len(hard) == 13


def test_sentences():
    assert tx.sentences("一。二！ three. four\nfive?") == ["一。", "二！", "three.", "four", "five?"]


def test_snippet_and_clip(spark):
    assert one(spark, "a\n b" * 100, lambda c: tx.snippet(c, 9)) == "a ba ba …"
    assert one(spark, "ab\ncd", lambda c: tx.clip(c, 4)) == "ab\n…" and one(spark, None, tx.snippet) == ""


def test_labels(spark):
    has = lambda t, label, **k: one(spark, t, lambda c: tx.has_label(c, label, **k))
    assert has("sweet pepper spot", "pepper") and not has("peppermint", "pepper") and has("番茄病", "番茄")
    assert not has("pre_pepper", "pepper") and has("pre_pepper", "pepper", underscore=False)


def test_identifiers(spark):
    path = one(spark, "../../etc/x y", tx.safe_component)
    assert "/" not in path and ".." not in path and path.endswith("etc_x_y")
    a = one(spark, "f1", lambda c: tx.thread_id(c, F.lit("2024-01-01")))
    assert a == one(spark, "F1", lambda c: tx.thread_id(c, F.lit("2024-01-01"))) and len(a) == 16
    assert one(spark, "甲；乙, 丙/ ", tx.alias_list) == ["甲", "乙", "丙"]


@pytest.mark.parametrize("text,want", [
    ("处置等级：立即处置", "Immediate"), ("**处置等级：** 尽快处置", "Soon"), ("Disposition - **Scheduled**", "Scheduled"), ("处置等级说明：立即处置 / 观察\n处置等级: 观察", "Monitor"),
    ("处置等级: 待人工复核\n立即处置", "REVIEW"), ("正文 需人工复核 紧急", "REVIEW"), ("we should observe", "Monitor"), ("", "REVIEW"), (None, "REVIEW"), ("nothing of note", "REVIEW"), ("rating: no", "REVIEW"),
])
def test_dispositions(spark, text, want):
    assert one(spark, text, parse.parse_disposition) == want


def test_levels(spark):
    f = lambda c: parse.first_level(c, ("high", "medium", "low"), "level")
    assert one(spark, "low\nlevel: medium", f) == "medium" and one(spark, "it is low", f) == "low" and one(spark, "?", f) == "unknown"
    assert one(spark, "工单编号：WO-7 \nx", parse.work_order_id) == "WO-7"
    assert one(spark, "Soon", parse.disposition_label) == "尽快处置"


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, float("nan")])], "a array<double>, z array<double>, n array<double>")
    r = row.select(vector.l2_normalize(F.col("a")), vector.l2_normalize(F.col("z")), vector.is_valid(F.col("n"), 2), vector.is_valid(F.col("a"), 2), vector.is_valid(F.col("a"), 3), vector.dot(F.col("a"), F.col("a"))).first()
    assert list(r) == [[0.6, 0.8], [0.0, 0.0], False, True, False, 25.0]
    assert vector.hashed_vector("a b c") == vector.hashed_vector("ABC") and abs(sum(x * x for x in vector.hashed_vector("abc")) - 1) < 1e-9
    assert sum(vector.hashed_vector("")) == 0 and vector.hash_embed_name() == "hashing-512-2-3"


def test_hashed_vectors_of_many_texts(spark, monkeypatch):
    """The same as one at a time, in small output batches whatever the input's."""
    import numpy as np
    import pyarrow as pa

    texts = ["a b c", "ABC", "", None, "a", "\x00\x00a", "x\U0010ffff\u756a\u8304 \ufb01", "late blight " * 50] * 3
    want = [vector.hashed_vector(t) for t in texts]
    assert np.array_equal(vector.hashed_vectors(texts), np.array(want)) and vector.hashed_vectors([]).shape == (0, 512)
    assert np.array_equal(vector.hashed_vectors(texts, 16, (4,)), np.array([vector.hashed_vector(t, 16, (4,)) for t in texts]))
    parts = list(vector._slices(pa.array(["x" * 1000] * 3000)))
    assert sum(map(len, parts)) == 3000 and max(map(len, parts)) <= 256
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    assert {r.i: r.v for r in df.select("i", vector.hash_embed("t").alias("v")).collect()} == dict(enumerate(want))


def test_plain_words_are_the_tokens(spark):
    """What the class leaves plain separates tokens and nothing else, beside any neighbour; other texts are not plain."""
    import pyarrow as pa

    code = [*range(0x80, 0x700), *range(0x1E00, 0x2600), *range(0x3000, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60)]
    rows = [f"The Ab{chr(c)}cD {chr(c)}x9 of{chr(c)}" for c in code] + ["", "a b", "Z", "e\u0301x", "İx", "番茄 leaf", "x\u0000y", "of", "é", "ÄB"]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, v string")
    got = df.select("k", "v", tx.plain(F.col("v")).alias("p"), tx.tokenize(F.col("v")).alias("t")).collect()
    plain = [r for r in got if r.p]
    assert len(plain) > 180 and not {"e\u0301x", "İx", "番茄 leaf"} & {r.v for r in plain}
    assert tx.plain_words(pa.array([r.v for r in plain])).to_pylist() == [r.t for r in plain]
    assert tx.plain_words(pa.array(["x", "A1 b", None, "y z", "is"]).slice(1)).to_pylist() == [["a1", "b"], [], ["y", "z"], []]
    assert tx.plain_words(pa.array([], pa.string())).to_pylist() == []
