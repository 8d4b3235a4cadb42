import json

import pytest
from pyspark.sql import functions as F

from larkfield.operators.components import connected_components
from larkfield.runtime import Scratch
from larkfield.sources import builders, publish, readers
from larkfield.streaming import ledger as stream


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("番茄".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("﻿番茄".encode())
    assert {r.text for r in readers.read_text_any(spark, str(tmp_path)).collect()} == {"番茄"}


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" x ,y\n 1 , a\n , \n2,b\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "a"), ("2", "b")]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_parquet_shards(spark, tmp_path):
    for k in range(2):
        spark.range(k + 2).write.parquet(str(tmp_path / f"s{k}"))
    assert readers.read_shards(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], ["id"]).count() == 5
    whole = next((tmp_path / "s0").glob("part-*"))
    assert readers.parquet_complete(str(whole))
    (tmp_path / "cut").write_bytes(whole.read_bytes()[:-9])
    assert not readers.parquet_complete(str(tmp_path / "cut")) and not readers.parquet_complete(str(tmp_path / "gone"))


def test_paging_and_fallback(spark):
    asked = []
    fetch = lambda at, n: asked.append((at, n)) or [{"i": i} for i in range(at, min(at + n, 250))]
    assert len(list(readers.paged_rows(fetch, 120))) == 120 and asked == [(0, 100), (100, 20)]
    assert len(list(readers.paged_rows(fetch))) == 250

    def broken():
        raise OSError

    df, mode = readers.with_fallback(broken, lambda: spark.range(9), 3, "id")
    assert mode == "paged" and df.count() == 3


def test_ledger_and_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"site_id": "s", "task_id": "t", "seq": 1}\n{broken\n')
    assert readers.read_ledger(spark, str(tmp_path / "l.jsonl")).count() == 1
    entry = "[2024-01-02 | s1 | Soon | pending]\nDECISION:\ndo it\nOUTCOME:\n\nREFLECTION:\nnone"
    (tmp_path / "log.md").write_text(entry + readers.SEPARATOR + entry.replace("s1", "s2") + readers.SEPARATOR)
    rows = readers.read_decision_log(spark, str(tmp_path / "log.md")).collect()
    assert [(r.as_of, r.site, r.status, r.decision, r.outcome, r.reflection) for r in rows] == [("2024-01-02", s, "pending", "do it", "", "none") for s in ("s1", "s2")]


META = {"source_ref": "https://x.org", "citation": "c", "publisher": "p", "retrieved_at": "2024-01-02", "applicability": "a", "evidence_status": "e"}


def test_curated_needs_provenance(spark):
    schema = "id string, kind string, title string, lang string, text string, meta map<string,string>"
    row = ("1", "agronomy", "t", "en", "x", META)
    assert builders.curated(spark.createDataFrame([row], schema)).columns == list(builders.COLUMNS)
    for bad in ({**META, "citation": " "}, {**META, "source_ref": "http://x"}, {**META, "retrieved_at": "2024-1-2"}):
        with pytest.raises(ValueError):
            builders.curated(spark.createDataFrame([(*row[:5], bad)], schema))


def test_local_rules(spark):
    schema = "id string, kind string, title string, text string, meta map<string,string>"
    ok = (None, "soil_record", "t", "x", {"source_ref": "r", "site_id": "GH-1"})
    out = builders.local(spark.createDataFrame([ok], schema), 1).first()
    assert out.doc_id.startswith("local:")
    for meta in ({"source_ref": "r"}, {"source_ref": "r", "site_id": "GH-*"}, {"source_ref": "r", "site_id": "ALL"}, {"site_id": "GH-1"}):
        with pytest.raises(ValueError):
            builders.local(spark.createDataFrame([ok, (*ok[:4], meta)], schema), 1)


def test_seed_cards_and_profiles(spark):
    s = spark.createDataFrame([("1", "k", "t", None, "x", None, {"a": "b", "demo": "no"})], "id string, kind string, title string, lang string, text string, parent string, meta map<string,string>")
    r = builders.seed(s).first()
    assert r.meta == {"a": "b", "demo": "true", "flags": "demo"} and r.lang == "zh"
    card = spark.createDataFrame([("d", "rot", "rice", "S", ["a"], {"leaf": ["x", "y"], "root": []}, "see", "", None, "high", ["z"])],
                                 "disease_id string, disease string, crop string, scientific string, aliases array<string>, symptoms map<string,array<string>>, diagnosis string, management string, environment string, severity string, lookalikes array<string>")
    docs = {r.doc_id: r.kind for r in builders.card_documents(card).collect()}
    assert sorted(docs.values()) == ["diagnosis", "disease_card", "lookalike", "severity", "symptom"] and "card:d:symptom:leaf" in docs
    p = spark.createDataFrame([("e", "句。" * 700)], "entity string, text string")
    assert builders.entity_profiles(p).count() == 3


def test_question_sources(spark):
    a = spark.createDataFrame([(1, "how to grow", "a" * 30), (2, "vitamin", "b" * 30), (3, "short", "c"), (4, "how to grow", "a" * 30)], "id int, question string, answer string")
    b = spark.createDataFrame([(1, "how to grow", "a" * 30)], "id int, prompt string, response string")
    out = builders.qa_english({"x": a, "y": b}, ["grow"], ["vitamin"]).collect()
    assert [(r.doc_id, r.meta["also_seen_in"]) for r in out] == [("qa_en:x:1", "x,y")]
    z = spark.createDataFrame([(i, "番茄", ("长文本" * 20) + str(i)) for i in range(5)] + [(9, "无关", "长文本" * 20)], "ord int, prompt string, response string")
    assert [r.doc_id[-1] for r in builders.qa_chinese(z, ["番茄"], ["肥"], ["肥"], accept=3).orderBy("doc_id").collect()] == ["0", "1", "2"]
    assert builders.resolve(["seed", "kg", "seed"]) == ["seed", "kg"]
    with pytest.raises(KeyError):
        builders.resolve(["nope"])


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    docs = spark.createDataFrame([("a", "s", "k", "x"), ("b", "s", "k", "y")], "doc_id string, source string, kind string, text string")
    vec = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, embedding array<double>")
    store = publish.Store(spark, str(tmp_path / "kb"))
    assert store.current() is None
    v = store.publish({"documents": docs, "vectors": vec}, publish.manifest(docs))
    with pytest.raises(ValueError):
        store.publish({"documents": docs.union(docs)}, {})
    with pytest.raises(ValueError):
        store.publish({"documents": docs, "vectors": vec.withColumn("embedding", F.array(F.lit(float("nan"))))}, {})
    assert store.current() == v and store.read("documents").count() == 2
    assert json.loads((tmp_path / "kb" / v / "manifest.json").read_text())["by_kind"] == {"k": 2}
    with store.lock(), pytest.raises(RuntimeError):
        store.publish({"documents": docs}, {})
    assert store.publish({"documents": docs}, {}) == store.current() != v


def test_ledger_stream(spark, tmp_path):
    led = spark.sql("SELECT 's' AS site_id, 'k' AS key, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM range(3)")
    led.write.json(str(tmp_path / "in"))
    rows = stream.first_of_each(stream.ledger_stream(spark, str(tmp_path / "in"), "site_id string, key string, ts timestamp"), ["site_id", "key"], "ts")
    q = rows.writeStream.format("memory").queryName("led").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("led").count() == 1


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (None, 3), (4, None), (50, 52)], [(i, 97 * i % 101) for i in range(1, 101)],
])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(df, Scratch(spark, "cc")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in list(root)} and len(got) == len(root)


def test_downloads(tmp_path):
    from larkfield.sources import download as d

    calls = []

    def opener(url):
        calls.append(url)
        if len(calls) < 3:
            raise d.HttpError(429) if len(calls) == 1 else ConnectionError()
        return b"data"

    path = str(tmp_path / "x" / "f")
    assert d.download("u", path, lambda u: d.get_bytes(u, opener, sleep=lambda s: None)) == path and len(calls) == 3
    d.download("u", path, opener)
    assert len(calls) == 3 and not (tmp_path / "x" / "f.part").exists()

    def gone(url):
        calls.append(url)
        raise d.HttpError(404)

    with pytest.raises(d.HttpError):
        d.get_bytes("u", gone, sleep=lambda s: None)
    assert len(calls) == 4
    with pytest.raises(OSError):
        d.download("u", path, lambda u: b"new", complete=lambda p: False)
    assert open(path, "rb").read() == b"data"
    assert d.first_endpoint(["/a"], ["m", "h"], lambda u: b"ok" if u == "h/a" else gone(u)) == b"ok"
    assert d.parquet_urls(b'{"c": {"train": ["1", "2"]}}', "c", "train") == ["1", "2"] and d.parquet_urls(b'{"parquet_files": [{"config": "c", "split": "s", "url": "3"}]}', "c", "s") == ["3"]


def test_knowledge_base(spark, tmp_path):
    from larkfield.operators.knowledge import KnowledgeBase, dataset_provenance
    from larkfield.operators.terms import dictionary

    rows = [
        ("a", "cards", "symptom", "late blight", "tomato leaves show water-soaked spots. " * 30 + "The stem turns brown.", "late blight", None, None, None, "ref-a"),
        ("b", "qa", "qa_pair", "watering", "water the tomato daily", None, None, None, None, ""),
        ("s", "seed", "soil_reference", "soil", "ph 6", None, "GH-1", None, None, "r"),
        ("e", "local", "equipment_manual", "pump", "fault E04: check the valve", None, None, "P-2", "E04", "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, source string, kind string, title string, text string, disease string, site_id string, device_id string, fault_code string, source_ref string")
    store = publish.Store(spark, str(tmp_path / "kb"))
    store.publish({"documents": docs}, {})
    kb = KnowledgeBase.open(store)
    kb.dictionary = dictionary(spark, {"t": ["番茄", "tomato"]})
    kb.symptoms = spark.createDataFrame([("late blight", 1, "water-soaked spots"), ("rust", 2, "orange dust")], "entity string, symptom_id int, symptom string")
    q = spark.createDataFrame([(1, "番茄 brown stem"), (2, "moon travel")], "query_id int, query_text string")
    got = kb.evidence(q).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {1} and got[0].doc_id == "a" and "brown" in got[0].snippet and got[0].citation == "ref-a" and len(got[0].snippet) <= 320
    assert kb.missing(["cards", "nope"], ["x"]) == ["source nope is not loaded", "kind x is not loaded"]
    assert kb.document("b").count() == 1 and kb.document("B").count() == 0 and kb.catalog().count() == 4
    assert kb.soil_reference(" gh-1").first().doc_id == "s" and kb.soil_reference("").count() == 0
    assert kb.equipment_manual("p-2", "e04").first().doc_id == "e" and kb.equipment_manual("p-2", "").count() == 0
    d = kb.diagnose(spark.createDataFrame([(1, "water-soaked spots")], "query_id int, query_text string")).collect()
    assert d[0].identity == "late blight" and kb.probe(["watering", "moon"]) == ["moon"]
    p = spark.createDataFrame([("a", "D1", [("D2", "x"), ("d1", "y")])], "doc_id string, dataset string, also_seen_in array<struct<dataset:string,doc_id:string>>")
    assert {tuple(r) for r in dataset_provenance(p).collect()} == {("a", "D1", "a"), ("a", "D2", "x")}


def test_a_failed_rename_leaves_the_old_pointer(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", "s", "k", "x")], "doc_id string, source string, kind string, text string")
    store = publish.Store(spark, str(tmp_path / "kb"))
    first = store.publish({"documents": docs}, {})
    assert store.publish({"documents": docs}, {}) != first
    old = store.current()

    def fails(version):
        raise OSError("no rename")

    monkeypatch.setattr(store, "_point", fails)
    with pytest.raises(OSError):
        store.publish({"documents": docs}, {})
    assert store.current() == old and store.read("documents").count() == 1 and not (tmp_path / "kb" / "LOCK").exists()
    (tmp_path / "kb" / "LOCK").write_text("")
    with pytest.raises(RuntimeError), store.lock():
        pass
    monkeypatch.setattr(publish, "STALE", -1)
    with store.lock():
        pass


def test_a_version_opens_with_its_dictionary(spark, tmp_path):
    from larkfield.operators.knowledge import KnowledgeBase
    from larkfield.operators.terms import dictionary

    docs = spark.createDataFrame([("a", "s", "equipment_manual", "t", "tomato pump", "m-1", ["P9"], "F1")], "doc_id string, source string, kind string, title string, text string, device_model string, device_aliases array<string>, fault_code string")
    store = publish.Store(spark, str(tmp_path / "kb"))
    store.publish({"documents": docs, "terms": dictionary(spark, {"t": ["番茄", "tomato"]})}, {})
    kb = KnowledgeBase.open(store)
    assert kb.vectors is None and kb.symptoms is None
    q = spark.createDataFrame([(1, "番茄 pump")], "query_id int, query_text string")
    assert [r.doc_id for r in kb.search(q).collect()] == ["a"]
    found = lambda device: [r.doc_id for r in kb.equipment_manual(device, "f1").collect()]
    assert found(" M-1") == ["a"] and found("p9") == ["a"] and found("pump") == [] and found("") == []
