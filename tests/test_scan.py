import random
import re

import pytest

from larkfield.functions.text import label_pattern, normalize_text
from larkfield.operators import scan


def brute(text, labels, bounded=True):
    """Every label tried at every place."""
    text, out = normalize_text(text), []
    for label in {normalize_text(x or "") for x in labels}:
        if len(label) >= 2:
            pattern = label_pattern(label) if bounded else re.escape(label)
            out += [(m.start(), -len(label), label) for m in re.finditer(f"(?=({pattern}))", text)]
    return [(label, at, at - n) for at, n, label in sorted(out)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("ab1番茄-. ", k=rng.randint(1, 5)))
    labels = [word() for _ in range(300)] + ["late blight", "blight", "Late  Blight", "ａｂ", "x", "", None, "番茄晚疫病"]
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["late blights, Late Blight; 番茄晚疫病blight", None, "", "ab " * 3000]
    return texts, labels


@pytest.mark.parametrize("size", [1 << 20, 150])
@pytest.mark.parametrize("bounded", [True, False])
def test_same_as_brute_force(spark, case, monkeypatch, size, bounded):
    texts, labels = case
    monkeypatch.setattr(scan.shards, "__defaults__", ("label", 2, size))
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("FOUND", scan.F.lit(1)).repartition(3)
    out = scan.find_labels(t, spark.createDataFrame([(x,) for x in labels], "label string"), bounded=bounded, name="places")
    got = {r.doc_id: [tuple(p) for p in r.places] for r in out.collect()}
    assert got == {i: brute(x, labels, bounded) for i, x in enumerate(texts)}


def test_leftmost_longest(spark, case):
    texts, labels = case
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = scan.find_labels(t, spark.createDataFrame([(x,) for x in labels], "label string"))
    for r in out.withColumn("apart", scan.leftmost(scan.F.col("found"))).collect():
        assert [(p.start, p.end) for p in r.apart] == scan.leftmost_longest([(p.start, p.end) for p in r.found])


def test_a_shard_holds_no_more_than_its_size(spark):
    labels = spark.range(3000).selectExpr("concat('pre', id) AS label")  # one head for all
    got = list(scan.shards(labels, size=2000))
    assert len(got) > 5 and max(sum(map(len, s)) for s in got) < 4000 and sum(map(len, got)) == 3000


def test_entities_longest_first(spark):
    names = spark.createDataFrame([("strawberry", "草莓"), ("anthracnose", "草莓炭疽病"), ("anthracnose", "炭疽"), ("b", "spot"), ("a", "spot")], "entity string, label string")
    t = spark.createDataFrame([(1, "草莓炭疽病 leafspots"), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.entity, r.label, r["rank"]) for r in scan.find_entities(t, names, limit=3).orderBy("doc_id", "rank").collect()]
    assert got == [(1, "anthracnose", "草莓炭疽病", 1), (1, "a", "spot", 2), (1, "b", "spot", 3)]
    assert scan.find_entities(t, names.limit(0)).count() == 0 and scan.find_entities(t.limit(0), names).count() == 0


def test_questions_and_cards_meet_by_name(spark):
    """A hot crop with many cards makes no pairs of questions and cards."""
    from larkfield.operators import domain

    cards = spark.range(2000).selectExpr("concat('d', id) AS disease_id", "array(concat('tomato rot', id)) AS names", "array('tomato') AS crops")
    asked = spark.createDataFrame([(1, "what of rot17?", ["tomato"]), (2, "tomato rot3", ["rice"])], "query_id int, query_text string, crops array<string>")
    assert [tuple(r) for r in domain.named_diseases(asked, cards).collect()] == [(1, "d17", "tomato")]


@pytest.mark.parametrize("chars, size", [(50, 1 << 20), (1 << 20, 40)])
def test_blocks_are_read_with_their_own_labels(spark, case, monkeypatch, chars, size):
    """Many blocks, or labels in many pieces, give what brute force finds; labels with words make no shards."""
    texts, labels = case
    monkeypatch.setattr(scan, "BLOCK_CHARS", chars)
    monkeypatch.setattr(scan, "SHARD_CHARS", size)
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: [tuple(p) for p in r.found] for r in scan.find_labels(t, spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    assert got == {i: brute(x, labels) for i, x in enumerate(texts)}
    monkeypatch.setattr(scan, "shards", lambda *a: pytest.fail("a shard goes to all texts"))
    found = scan.find_labels(t, spark.createDataFrame([("late blight",), ("ab",)], "label string"))
    assert {r.doc_id: [tuple(p) for p in r.found] for r in found.collect()} == {i: brute(x, ["late blight", "ab"]) for i, x in enumerate(texts)}
