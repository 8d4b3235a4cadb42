import random

import numpy as np
import pyarrow as pa
import pytest

from larkfield.operators import filters, inverted, lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["番茄", "黄瓜叶"]
    rows = [(i, " ".join(rng.choices(words, range(62, 0, -1), k=rng.choice([0, 3, 10, 40]))), rng.choice("ab")) for i in range(700)]
    rows += [(9000, None, "a"), (9001, "", "a"), (9002, "w0 " * 5000, "b"), (None, "w1 w2", "b"), (5, rows[5][1], "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return inverted.build(corpus, str(tmp_path_factory.mktemp("inverted") / "x"), buckets=8, block_docs=16)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "w1 w5 w33"), (2, "w50 番茄 w0 w0"), (3, "nothing here"), (4, ""), (5, None), (6, "treatment w3"), (7, "disease treatment")]
    return spark.createDataFrame(rows, "query_id int, query_text string")


def hits(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("gate", [True, False])
def test_same_scores_as_a_scan(spark, corpus, index, asked, gate):
    assert index.stats.n == corpus.count() and index.stats.blocks >= 45
    assert hits(index.bm25(asked, gate=gate)) == hits(lexical.bm25(asked, corpus, gate=gate))


@pytest.mark.parametrize("limited", [False, True])
@pytest.mark.parametrize("many", [1, 10**6])
def test_same_ranks_with_early_termination(spark, corpus, index, asked, monkeypatch, limited, many):
    monkeypatch.setattr(inverted, "MANY_BLOCKS", many)
    few = filters.allowed(corpus, {"lang": "b"}) if limited else None
    top = lambda scores: lexical.ranked(scores, "bm25_score", most=3).where("doc_id IS NOT NULL")
    assert hits(top(index.bm25(asked, few, most=3))) == hits(top(lexical.bm25(asked, corpus, few, most=3)))


def test_empty_candidates_and_index(spark, corpus, index, asked, tmp_path):
    assert index.bm25(asked, corpus.limit(0)).count() == 0
    assert inverted.build(corpus.limit(0), str(tmp_path / "none")).bm25(asked, most=3).count() == 0


def test_only_the_buckets_of_the_terms_are_read(index):
    lists = index.lists(["w1"])
    files = {f.split("bucket=")[1].split("/")[0] for f in lists.inputFiles()}
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    scan = index.table("postings").where(f"bucket in ({','.join(sorted(files))})")
    assert scan.select("bucket").distinct().count() == len(files)
    assert lists.select("block").distinct().count() == lists.count() <= index.stats.blocks


def test_blocks_below_the_floor_are_not_scored():
    def lists(*rows):
        return pa.table({"term": pa.array([r[0] for r in rows]), "slots": pa.array([[0]] * len(rows), pa.list_(pa.int32())), "tfs": pa.array([[r[1]] for r in rows], pa.list_(pa.int32())), "dls": pa.array([[4]] * len(rows), pa.list_(pa.int32())), "top_tf": pa.array([r[1] for r in rows], pa.int32()), "low_dl": pa.array([4] * len(rows), pa.int32())})

    q = pa.table({"query_id": [1, 1, 2], "term": ["a", "b", "b"], "informs": [True, True, True]})
    asked = inverted._Asked(q, {"a": 2, "b": 5}, 10, 4.0)
    rows = lists(("a", 3), ("b", 1), ("c", 9))
    query, _, score, read = inverted.block_scores(asked, rows, 5, True, np.zeros(2))
    assert sorted(query.tolist()) == [0, 1] and read == 2
    high = np.array([score[query == 0][0] + 1, 0.0])
    query, _, _, read = inverted.block_scores(asked, rows, 5, True, high)
    assert query.tolist() == [1] and read == 1  # query 1 can't reach its floor here: only the list of b is read
    assert inverted.block_scores(asked, rows, 5, True, np.array([99.0, 99.0]))[3] == 0


def test_lists_are_bounded_and_complete(index, corpus):
    rows = index.table("postings").selectExpr("max(size(slots)) AS longest", "sum(size(slots)) AS n").first()
    want = lexical.postings(lexical.with_tokens(corpus.withColumn("doc_id", lexical.F.monotonically_increasing_id()))).count()
    assert rows.longest <= 16 and rows.n == want


def test_published_with_tables_that_stay(spark, corpus, asked, tmp_path):
    """A version that rewrites one of three tables refers to the files of the others, and searches as before."""
    from larkfield.sources import publish

    store = publish.Store(spark, str(tmp_path / "kb"))
    docs = corpus.where("doc_id IS NOT NULL AND text <> ''").dropDuplicates(["doc_id"]).selectExpr("*", "'s' AS source", "'k' AS kind")
    vectors = docs.selectExpr("doc_id", "array(1.0D, 0.0D) AS embedding")
    first = store.publish({"documents": docs, "vectors": vectors}, {}, writers={"inverted": lambda path: inverted.build(docs, path, block_docs=64)})
    found = hits(inverted.Index(spark, store.place("inverted")).bm25(asked))
    files = {t: sorted(store.read(t).inputFiles()) for t in ("documents", "vectors")}
    second = store.publish({"vectors": vectors.selectExpr("doc_id", "array(0.0D, 1.0D) AS embedding")}, {}, keep=["documents", "inverted"])
    assert sorted(store.read("documents").inputFiles()) == files["documents"] and sorted(store.read("vectors").inputFiles()) != files["vectors"]
    assert not (tmp_path / "kb" / second / "documents").exists()
    assert hits(inverted.Index(spark, store.place("inverted")).bm25(asked)) == found
    assert store.unused(keep=1) == [f"{first}/vectors"]
    with pytest.raises(FileNotFoundError):
        store.publish({}, {}, keep=["gone"])
    assert store.current() == second


def test_a_lock_that_was_taken_over_stops_its_first_owner(spark, tmp_path, monkeypatch):
    from larkfield.sources import publish

    store = publish.Store(spark, str(tmp_path / "kb"))
    with pytest.raises(RuntimeError, match="taken over"):
        with store.lock() as renew:
            renew()
            monkeypatch.setattr(publish, "STALE", -1)
            with publish.Store(spark, str(tmp_path / "kb")).lock():
                renew()
