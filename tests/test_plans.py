import re

import pytest

from larkfield.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedupe_exact", "exact_copies", "stratified_sample", "last_n_context", "site_pairs", "disjunctive_match", "settlement", "doc_catalog", "dictionary_scan", "window_stats", "router_branches"])
def test_no_python_and_no_pairs(spark, sf, name):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", p)


def test_documents_are_scored_where_they_lie(spark, sf):
    """No join of a document's terms with the queries', and nothing but the best of each batch is shuffled."""
    p = plan(catalog.QUERIES["bm25_topk"](spark, sf))
    assert "Join" not in p and p.count("Exchange") == 1 and p.count("MapInArrow") == 1 and "hashpartitioning(query_id" in p
    from larkfield.operators import lexical

    d = spark.createDataFrame([(k, "red blue") for k in range(500)], "doc_id int, text string").coalesce(1)
    q = spark.createDataFrame([(1, "red")], "query_id int, query_text string")
    assert lexical.bm25(q, d).count() == 500
    d = spark.createDataFrame([(k, "red " * (1 + k % 50) + "blue") for k in range(500)], "doc_id int, text string").coalesce(1)
    assert lexical.bm25(q, d, most=5).count() < 100  # each batch gives its five best, with ties


def test_copies_samples_and_lessons_stay_spread(spark, sf):
    p = plan(catalog.QUERIES["dedupe_exact"](spark, sf))
    assert "collect_list" not in p
    p = plan(catalog.QUERIES["last_n_context"](spark, sf))
    assert "Window" not in p and p.count("TakeOrderedAndProject") == 2
    p = plan(catalog.QUERIES["stratified_sample"](spark, sf))
    assert "Window [row_number() windowspecdefinition(_p" in p


def test_blocks_of_queries_give_the_same(spark, sf, monkeypatch):
    from larkfield.operators import lexical

    whole = sorted(map(str, catalog.QUERIES["bm25_topk"](spark, sf).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 30)
    monkeypatch.setattr(lexical, "CELLS", 2000)
    assert sorted(map(str, catalog.QUERIES["bm25_topk"](spark, sf).collect())) == whole


def test_filters_and_columns_reach_the_scan(spark, sf):
    from larkfield.operators import filters

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = plan(filters.allowed(docs, {"lang": ["de", "fr"]}).select("doc_id"))
    assert "PushedFilters: [In(lang, [de,fr])]" in p and "ReadSchema: struct<doc_id:bigint,lang:string>" in p
    p = plan(catalog.QUERIES["latest_per_key"](spark, sf))
    assert "props" not in p and "WindowGroupLimit" in p


def test_ranks_are_cut_before_the_shuffle(spark, sf):
    p = plan(catalog.QUERIES["bm25_topk"](spark, sf))
    assert p.count("WindowGroupLimit") == 2


def test_alias_components_over_whole_keys(spark, sf):
    """Every customer and order of the table is a name, in the group that brute force finds."""
    from larkfield.plans import catalog

    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        x, y = sorted((find(f"c{r.o_custkey}"), find(f"o{r.o_orderkey}")))
        root[y] = x
    got = {r.name: r.group_id for r in catalog.QUERIES["alias_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert len(got) == len({r.o_custkey for r in rows}) + len({r.o_orderkey for r in rows})


def test_documents_are_scored_in_slices_of_bounded_tokens():
    import pyarrow as pa

    from larkfield.operators import lexical

    lists = [["a"] * n for n in (100_000, 100_000, 100_000, 600_000, 0, 5)] + [None] + [["b"]] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    parts = [p.column(0).to_pylist() for p in lexical._slices(batch, 1, 1000)]
    assert sum(parts, []) == list(range(len(lists))) and parts[:3] == [[0, 1], [2], [3]] and max(map(len, parts)) == 1000


def test_texts_go_to_tasks_whole(spark, sf):
    """No token of a plain text is made in the JVM, one by one, for the searches that scan and for the index."""
    from larkfield.operators import lexical

    d = spark.createDataFrame([(1, "Red café"), (2, "番茄 red"), (3, None), (4, "the")], "doc_id int, text string")
    rows = {r.doc_id: (r.text, r.tokens) for r in lexical.with_words(d).collect()}
    assert rows == {1: ("Red café", None), 2: (None, ["番", "茄", "番茄", "red"]), 3: ("", None), 4: ("the", None)}
    batch = lexical.with_words(d.coalesce(1)).toArrow().combine_chunks().to_batches()[0]
    assert [t for _, lists in lexical.listed(batch, 3) for t in lists.to_pylist()] == [["red", "caf"], ["番", "茄", "番茄", "red"], [], []]
    q = spark.createDataFrame([(1, "red 番茄")], "query_id int, query_text string")
    assert {r.doc_id for r in lexical.bm25(q, d).collect()} == {1, 2}
    p = plan(catalog.QUERIES["bm25_filtered_topk"](spark, sf))
    assert "CASE WHEN _plain" in p


def test_the_gate_is_counted_in_tasks(spark, sf):
    p = plan(catalog.QUERIES["lexical_gate"](spark, sf))
    assert "bm25_score" not in p
    from larkfield.operators import lexical

    d = spark.createDataFrame([(k, "red blue" if k % 2 else "plant blue") for k in range(500)], "doc_id int, text string").coalesce(1)
    q = spark.createDataFrame([(1, "red plant"), (2, "blue"), (3, "none"), (4, "plant")], "query_id int, query_text string")
    assert {r.query_id: r.n for r in lexical.gated(q, d).collect()} == {1: 250, 2: 500}


def test_the_best_of_each_group_are_cut_in_tasks(spark, sf):
    p = plan(catalog.QUERIES["grouped_top3_weighted"](spark, sf))
    assert "Join" not in p and "source" in p
    from larkfield.operators import lexical

    d = spark.createDataFrame([(k, "red " * (1 + k // 3) + "blue", "abc"[k % 3] if k % 3 else None) for k in range(300)], "doc_id int, text string, source string").coalesce(1)
    q = spark.createDataFrame([(1, "red")], "query_id int, query_text string")
    every = lexical.bm25(q, d).join(d, "doc_id")
    best = lambda rows: sorted(map(str, lexical.ranked(rows.select("query_id", "doc_id", "bm25_score", "source"), "bm25_score", ["query_id", "source"], most=3).collect()))
    few = lexical.bm25(q, d, most=3, by="source")
    assert few.count() < 60 and best(few) == best(every) and len(best(few)) == 9


def test_full_width_tokens_of_whole_texts(spark, tmp_path):
    """Every token of a document, however many it has, in the code as in its SQL."""
    import duckdb

    rows = [(n, " ".join(f"The W{i}," for i in range(n))) for n in (0, 1, 50, 51, 3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {n: " ".join(f"w{i}" for i in range(n)) for n, _ in rows}
    assert {r.doc_id: r.tokens for r in catalog.QUERIES["full_width_tokens"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(catalog.SQL["full_width_tokens"]).fetchall()) == want
