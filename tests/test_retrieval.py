import math

import pytest
from pyspark.sql import functions as F

from larkfield.operators import corpus, dense, evaluation, filters, fusion, identity, kg, lexical
from larkfield.operators.terms import dictionary, enrich, expand_queries, terms_from_cards, terms_from_entities
from larkfield.runtime import Scratch


def docs(spark, n=60):
    rows = [(f"d{i:02d}", "symptom", f"t{i}", "番茄 leaf spot disease wilt", "番茄", ["x"]) for i in range(n)] + [("z", "symptom", "target", "黄瓜 leaf spot", "黄瓜", ["Y ", "w"])]
    return spark.createDataFrame(rows, "doc_id string, kind string, title string, text string, crop string, tags array<string>")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")


def test_filter_comes_before_the_cut(spark):
    d = docs(spark)
    hits = lexical.ranked(lexical.bm25(ask(spark, "leaf spot"), d, filters.allowed(d, meta={"crop": "黄瓜"})), "bm25_score", most=3)
    assert [r.doc_id for r in hits.collect()] == ["z"]


@pytest.mark.parametrize("meta,n", [({"crop": []}, 0), ({"tags": "y"}, 1), ({"tags": ["Y", "X"]}, 61), ({"crop": "黄瓜", "tags": "x"}, 0), ({"crop": ["番茄", "黄瓜"]}, 61)])
def test_metadata_predicates(spark, meta, n):
    assert filters.allowed(docs(spark), meta=meta).count() == n


def test_empty_filters_reject_all(spark):
    d = docs(spark)
    assert filters.allowed(d, {"kind": []}).count() == 0 and filters.allowed(d, {"kind": None}).count() == 61
    assert filters.allowed(d, ids=[]).count() == 0 and filters.allowed(d, ids=["z"]).count() == 1
    assert filters.meta_table(d, "doc_id", ["crop", "tags"]).where("doc_id = 'z'").count() == 3


def test_bm25_by_hand(spark):
    d = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.bm25_score for r in lexical.bm25(ask(spark, "red red blue"), d).collect()}
    n, avgdl = 4, (3 + 2 + 1 + 1) / 4
    part = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got == {1: round(part(2, 1, 3) + part(1, 2, 3), 6), 2: round(part(1, 2, 2), 6)}


def test_lexical_gate(spark):
    d = docs(spark)
    assert lexical.bm25(ask(spark, "disease treatment", "管理 方法"), d).count() == 0
    v = spark.createDataFrame([("d01", [1.0, 0.0])], "doc_id string, embedding array<double>")
    q = ask(spark, "moon travel").withColumn("query_vector", F.array(F.lit(1.0), F.lit(0.0)))
    assert fusion.hybrid_search(q, d, v).count() == 0


def test_hybrid_prefers_exact_titles_and_both_lists(spark):
    d = spark.createDataFrame([(1, "other", "apple tart tart"), (2, "Apple Tart", "apple"), (3, "third", "pear")], "doc_id int, title string, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "doc_id int, embedding array<double>")
    q = ask(spark, "apple tart").withColumn("query_vector", F.array(F.lit(1.0), F.lit(0.0)))
    rows = fusion.hybrid_search(q, d, v, title_col="title").orderBy("rank").collect()
    assert [(r.doc_id, r.how) for r in rows] == [(2, "bm25#1" if rows[0].bm25_rank == 1 else "bm25#2"), (1, rows[1].how), (3, "dense#2")]
    assert rows[1].dense_rank == 1


def test_dense_threshold_follows_the_cut(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(10)] + [(99, [1.0])], "doc_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    rows = dense.dense_top(q, v, most=6).collect()
    best = sorted(range(10), key=lambda i: (-round(math.cos(i), 6), i))[:6]
    assert sorted(r.doc_id for r in rows) == sorted(i for i in best if math.cos(i) > 0.15)
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 0.0])], "doc_id int, embedding array<double>")
    assert not dense.validity(bad).first().usable and not dense.validity(v).first().usable and not dense.validity(v.limit(0)).first().usable


def test_dedupe_keeps_provenance(spark):
    rows = [(3, " same　", "b"), (1, "same", "a"), (2, "\n", "a"), (4, "other", "c"), (5, None, "c"), (6, "same", "d")]
    got = {r.doc_id: r for r in corpus.dedupe_exact(spark.createDataFrame(rows, "doc_id int, text string, source string"), max_chars=3, with_copies=True).collect()}
    assert set(got) == {1, 4} and [(x.doc_id, x.source) for x in got[1].also_seen_in] == [(3, "b"), (6, "d")] and got[4].text == "oth"


def test_gate_profile_catalog_sample(spark):
    d = spark.createDataFrame([(1, "a", "s"), (1, " ", "s"), (None, "x", None)], "doc_id int, text string, source string")
    assert corpus.gate(d).first().asDict() == {"n_docs": 3, "n_blank": 1, "n_no_id": 1, "n_duplicate_ids": 1, "n_no_source": 1}
    s = spark.createDataFrame([("g", i) for i in range(11)] + [("h", 1)], "g string, i int")
    assert sorted(r.i for r in corpus.spaced_sample(s, "g", "i", 3).where("g = 'g'").collect()) == [0, 5, 10]
    assert corpus.spaced_sample(s, "g", "i", 1).where("g = 'g'").first().i == 0


def test_scope_rules(spark):
    d = spark.createDataFrame([("grow vitamin", "x"), ("vitamin", "grow"), ("q", "vitamin"), ("q", "vitamin grow")], "q string, a string")
    assert [r[0] for r in d.select(corpus.excluded(F.col("q"), F.col("a"), ["grow"], ["vitamin"])).collect()] == [False, True, True, False]
    t = spark.createDataFrame([("crop a",), ("a b",), ("a c",), ("a",)], "t string")
    assert [r[0] for r in t.select(corpus.relevance(F.col("t"), ["crop"], ["a", "b", "c"], ["b"])).collect()] == [12, 2, 0, 0]


def test_identity_refuses_ambiguity(spark):
    m = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, t int")
    assert [tuple(r) for r in identity.unique_or_nothing(m, "k", "t").collect()] == [("a", 1)]
    fb = spark.createDataFrame([("b", 9), ("c", 3)], "k string, t int")
    assert sorted(map(tuple, identity.link_with_fallback(m, fb, "k", "t").collect())) == [("a", 1), ("c", 3)]


def test_alias_index_and_groups(spark):
    rows = [("t1", "Rice ", 2), ("t2", "rice", 1), ("crop:x", "RICE", 9), ("t3", "r", 1)]
    lab = spark.createDataFrame(rows, "term_id string, label string, ord int")
    assert [tuple(r) for r in identity.alias_index(lab, preferred=F.startswith("term_id", F.lit("crop:"))).collect()] == [("rice", "crop:x")]
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in identity.alias_groups(pairs, Scratch(spark, "t")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}


def test_disjunctive_match_is_a_union_of_joins(spark):
    a = spark.createDataFrame([(1, "p", "q"), (2, "r", None)], "l int, x string, y string")
    b = spark.createDataFrame([(7, "p", "q"), (8, "z", "r")], "r int, u string, v string")
    out = identity.any_of(a, b, "l", "r", [("x", "u"), ("y", "v"), ("x", "v")])
    assert {tuple(r) for r in out.collect()} == {(1, 7), (2, 8)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_exact_records(spark):
    d = spark.createDataFrame([(1, "GH-1", False), (2, "gh-1 ", True), (3, "GH-10", False)], "doc_id int, site string, demo boolean")
    assert [r.doc_id for r in identity.exact_records(d, {"site": "gh-1"}, ["doc_id"], demo=F.col("demo")).collect()] == [1, 2]
    assert identity.exact_records(d, {"site": " "}, ["doc_id"]).count() == 0 and identity.exact_records(d, {"site": "gh-1"}, ["doc_id"], top_k=0).count() == 0


def test_symptom_match(spark):
    s = spark.createDataFrame([("blight", 1, "water soaked spots"), ("blight", 2, "white mold"), ("rust", 3, "orange spots"), ("mosaic", 4, "leaf curl")], "entity string, symptom_id int, symptom string")
    rows = kg.match_symptoms(ask(spark, "water soaked spots"), s).orderBy("rank").collect()
    assert rows[0].entity == "blight" and rows[0].score == 0.7 and {r.entity for r in rows} == {"blight", "rust"}


def test_kg_tables(spark):
    assert kg.value_columns(["number", "Chinese entity name", "entity binomial scientific name", "中文", "value en", "relation zh", "relation en"]) == ["中文", "value en"]
    t = spark.createDataFrame([("e", "甲", "a", 1), ("e", "甲", "b", 2), (" ", "x", "y", 3)], "entity string, `v zh` string, `v en` string, ord int")
    r = kg.entities(kg.edges({"crops": t})).first()
    assert (r.values_zh, r.values_en) == (["甲"], ["a", "b"])
    names = spark.createDataFrame([("chili pepper",), ("x",)], "name string")
    crops = spark.createDataFrame([("pepper",), ("red chili pepper",)], "crop string")
    assert kg.related_crops(names, crops).count() == 2


def test_query_expansion(spark):
    d = dictionary(spark, {"crop:tomato": ["tomato", "番茄"], "d1": ["late blight", "晚疫病"], "d2": ["blight", "疫病"], "d3": ["Tomato late blight", "x y"], "m": ["mosaic", "a1", "a2"], "r": ["rust", "b1"]})
    cases = {
        "late blight of Tomato": "late blight of Tomato 晚疫病 番茄", "tomatoes": "tomatoes", "blight": "blight 疫病", "trust": "trust",
        # every place of a long name is taken, so the shorter ones inside it add nothing, wherever they stand
        "tomato late blight and tomato late blight": "tomato late blight and tomato late blight x y",
        "late blight, blight": "late blight, blight 晚疫病 疫病", "番茄ｍｏｓａｉｃ": "番茄ｍｏｓａｉｃ a1 a2 tomato",
        "chlorosis on leaves": "chlorosis on leaves yellowing 黄化", "": "",
    }
    got = expand_queries(ask(spark, *cases, None).withColumn("other", F.lit(1)), d)
    assert got.columns == ["query_id", "query_text", "other"]
    assert [r.query_text for r in got.orderBy("query_id").collect()] == [*cases.values(), ""]
    four = expand_queries(ask(spark, "mosaic rust blight"), d, max_terms=1).first().query_text
    assert four == "mosaic rust blight 疫病"


def test_full_width_text_is_found(spark):
    d = spark.createDataFrame([(1, "late blight"), (2, "ｌａｔｅ　ｂｌｉｇｈｔ"), (3, "early rot")], "doc_id int, text string")
    assert {r.doc_id for r in lexical.bm25(ask(spark, "ＬＡＴＥ blight"), d).collect()} == {1, 2}


def test_term_sources(spark):
    e = spark.createDataFrame([("病", "Sci", ["d"], ["甲", "乙"], ["a", "b"]), ("症", "", [], ["丙"], ["c", "d"])], "name string, scientific string, english array<string>, crops array<string>, crops_en array<string>")
    got = {(r.term_id, r.lang, r.label) for r in terms_from_entities(e).collect()}
    assert ("crop:甲", "en", "a") in got and ("crop:丙", "zh", "丙") in got and ("crop:丙", "en", "c") not in got and ("entity:病", "la", "Sci") in got
    c = spark.createDataFrame([("x", "rot", ["decay"], "Sci", "rice")], "disease_id string, disease string, aliases array<string>, scientific string, crop string")
    got = {(r.term_id, r.label) for r in terms_from_cards(c).collect()}
    assert got == {("card:x", "rot"), ("card:x", "decay"), ("card:x", "Sci"), ("crop:rice", "rice")}
    lab = terms_from_cards(c)
    cache = spark.createDataFrame([("en", "rot", "zh", "腐"), ("en", "decay", "zh", None)], "lang string, label string, other_lang string, other_label string")
    assert enrich(lab, cache).count() == 5


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 2), (3, 13, 1)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 12), (3, 99)], "query_id int, doc_id int")
    r = evaluation.metrics(evaluation.first_hits(ranked, ranked, gold)).first()
    assert (r.n_queries, r.hit_1, r.hit_3, r.mrr) == (3, 0.0, round(2 / 3, 6), round(1 / 3, 6))
