import random
import unicodedata

from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.functions import nfkc as nfkc_module
from larkfield.functions.nfkc import _FOLLOW, _PLACES, nfkc


def held(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    return {r.i: r.n for r in df.select("i", nfkc(F.col("t")).alias("n")).collect()}


def test_every_character_and_its_forms(spark):
    """Each character of the database alone, taken apart in both ways, and behind and before others, eight to a text."""
    forms = [f for c in _PLACES for f in {c, unicodedata.normalize("NFD", c), unicodedata.normalize("NFKD", c)}]
    texts = ["|".join(f"a{f}b" for f in forms[i : i + 200]) for i in range(0, len(forms), 200)]
    got = held(spark, texts)
    wrong = [(a, b) for i, t in enumerate(texts) for a, b in zip(unicodedata.normalize("NFKC", t).split("|"), got[i].split("|")) if a != b]
    assert not wrong, wrong[:5]


def test_random_sequences(spark):
    rng = random.Random(1)
    marks, some = sorted(_FOLLOW), [*"aeIoué한가ㅏ각ｶ゛ﾞ᾽ǆΩ", "ﷺ", "ﬁ", "½", "℡", "क़", "ྲ", "ᄀ", "ᅡ", "ᆨ", " ", "\n", "\U0001d15e"]
    texts = ["".join(rng.choice(marks) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    got = held(spark, [*texts, None, "", "plain", "x" * 100_000 + "ẹ́"])
    assert [got[i] for i in range(len(texts))] == [unicodedata.normalize("NFKC", t) for t in texts]
    assert [got[len(texts) + k] for k in range(3)] == [None, "", "plain"] and got[len(texts) + 3].endswith("xẹ́")


def test_tokens_meet_whatever_the_form(spark):
    forms = ["Café ﬁne ½ ㌔", "Café fine 1⁄2 キロ"]
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    a, b = [tuple(r) for r in df.select(tx.tokenize(F.col("t")), tx.query_terms(F.col("t")), tx.normalize(F.col("t"))).collect()]
    assert a == b and "fine" in a[0] and a[2] == tx.normalize_text(forms[0])
    assert "Python" not in df.select(tx.normalize(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_plans_are_short(spark):
    """A plan holds no tables of characters, and what makes a text is in it once."""
    p = spark.range(1).select(tx.tokenize(F.concat(F.lit("once"), F.col("id").cast("string"))).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert len(p) < 10_000 and p.count("once") == 1


def test_letters_taken_apart(spark):
    texts = ["Caf\u00e9 \uac01 \u1e69\ufb01", "plain", "\U000105c9\u00e9", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfkc_module.nfd(F.col("t")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: t and unicodedata.normalize("NFD", t) for i, t in enumerate(texts)}


def test_characters_that_python_does_not_know(spark):
    """They stay, and cut what is composed, as unassigned ones do."""
    texts = ["\U0001ccd6e\u0301", "e\u0301\u0897e\u0301\ufb01", "e\u0897\u0301", "\u0897", "\U000105d2\u0307", "\U0001f600e\u0301"]
    assert held(spark, texts) == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
