import corpus_pipeline as p
from larkfield.llm import near_dedup
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_pii import brute as personal


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [f.__name__ for _, f in p.STAGES] == ["identify_language", "drop_near_duplicates", "drop_contaminated", "redact_personal_data", "mix_sources"]
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert set(now) <= set(was) and docs.count() == len(now)
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name == "language":
            assert len(now) > 0.95 * len(was)
        if name == "near duplicates":
            assert set(now) == {c for _, _, c in groups([(r.doc_id, r.text) for r in was.values()], p.NEAR_PERCENT)}
        if name == "decontamination":
            assert set(now) == {i for i, r in was.items() if not contaminated(r.text, items)[1]}
        if name == "personal data":
            assert set(now) == set(was)
            for i, r in now.items():
                assert not [s for s in personal(r.text) if s[1] in (0, 3)] and r.n_chars == len(r.text)
                if not personal(was[i].text):
                    assert r.text == was[i].text or "<" in r.text
        if name == "mixture":
            assert all(r.epochs or r.last_tokens for r in now.values())


def test_stages_take_any_rows(spark, sf):
    """Nulls in any column, repeated rows, columns whose names clash, and empty tables."""
    rows = [(1, None, None, None, None, "a"), (1, None, None, None, None, "a"), (None, "words and more words", "en", "src1", 20, None), (3, "", "de", None, 0, "b"), (4, "the words " * 9000, None, "src2", 90_000, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).collect()
        p.mix_sources(spark, docs, sf).collect()
    assert near_dedup.near_duplicates(spark.createDataFrame(rows, schema), percent=80).count() == 5


def test_run(spark, sf):
    rows = p.run(spark, sf)
    assert rows.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epochs", "last_tokens"] and rows.count() > 0
