"""Retrieval queries over the driver's tables, with SQL that gives the same rows.

``benchmark`` passages are the queries, ``documents`` the corpus. Pairing an embedding with the document or
passage of the same number is a convention of these queries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.functions.text import QUERY_FILLER_EN, STOP_WORDS, query_terms, tokenize
from larkfield.operators import corpus, dense, evaluation, filters, fusion, identity, inverted, lexical
from larkfield.runtime import Scratch, read_table

#: phrase groups for masks over the invented prose of the tables
GROUPS = (("thing", "ation"), ("heit", "keit"), ("eaux", "aient"), ("ción", "mente"))

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: NOT list_contains({_LIST(STOP_WORDS)}, t))"


def sql_informative(term: str) -> str:
    return f"(length({term}) >= 2 AND NOT list_contains({_LIST(QUERY_FILLER_EN)}, {term}))"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = tokenize(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def informative_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("query_id", F.array_join(F.array_sort(query_terms(F.col("query_text"))), " ").alias("terms"))


def _bm25(spark, sf, candidates=None, most=5, name="rank"):
    scores = lexical.bm25(_asked(spark, sf), _docs(spark, sf), candidates, most=most)
    return lexical.ranked(scores, "bm25_score", most=most, name=name)


def _cast(df: DataFrame, *ranks: str) -> DataFrame:
    return df.withColumns({r: F.col(r).cast("long") for r in ranks})


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _cast(_bm25(spark, sf), "rank")


def _index(spark: SparkSession, sf: str) -> inverted.Index:
    return inverted.build(_docs(spark, sf), Scratch(spark, "index").path("inverted"))


def bm25_published(spark: SparkSession, sf: str) -> DataFrame:
    """``bm25_topk`` over an index on disk, built here once; the search reads the buckets of its terms."""
    return _cast(lexical.ranked(_index(spark, sf).bm25(_asked(spark, sf), most=5), "bm25_score", most=5), "rank")


def bm25_published_filtered(spark: SparkSession, sf: str) -> DataFrame:
    few = filters.allowed(_docs(spark, sf), {"lang": ["de", "fr"]}, {"source": "SRC3"})
    return _cast(lexical.ranked(_index(spark, sf).bm25(_asked(spark, sf), few, most=5), "bm25_score", most=5), "rank")


def posting_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the index holds of each term: documents, occurrences, and the highest frequency that its lists name."""
    rows = _index(spark, sf).table("postings")
    total = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.groupBy("term").agg(F.sum(F.size("slots")).alias("df"), total.alias("cf"), F.max("top_tf").cast("long").alias("top_tf"))


def bm25_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The filter comes before the ranks, so a query still gets five rows; statistics stay those of the corpus."""
    return _cast(_bm25(spark, sf, filters.allowed(_docs(spark, sf), {"lang": ["de", "fr"]}, {"source": "SRC3"})), "rank")


def bm25_empty_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A filter that allows nothing gives nothing."""
    return _cast(_bm25(spark, sf, filters.allowed(_docs(spark, sf), {"source": []})), "rank")


def lexical_gate(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.gated(_asked(spark, sf), _docs(spark, sf)).withColumnRenamed("n", "n_candidates")


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    v = _vectors(spark, sf)
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _cast(dense.dense_top(q, v), "dense_rank")


def vector_validity(spark: SparkSession, sf: str) -> DataFrame:
    return _cast(dense.validity(_vectors(spark, sf)), "min_dim", "max_dim")


def _hybrid(spark, sf, top_k):
    q = _asked(spark, sf).join(_vectors(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    return fusion.hybrid_search(q, _docs(spark, sf), _vectors(spark, sf), top_k=top_k)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    out = _hybrid(spark, sf, 5)
    out = out.fillna(0, ["bm25_rank", "dense_rank"])  # 0: the list doesn't hold the row
    return _cast(out, "rank", "bm25_rank", "dense_rank").select("query_id", "doc_id", "bm25_rank", "dense_rank", "score", "rank", "how")


def overfetch_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty by BM25, ordered anew by shared topics, score and id, and cut to five."""
    hits = _bm25(spark, sf, most=20, name="hit")
    topics = _docs(spark, sf).select("doc_id", corpus.mask(F.lower("text"), GROUPS).alias("m"))
    asked = _asked(spark, sf).select("query_id", corpus.mask(F.lower("query_text"), GROUPS).alias("q"))
    rows = hits.join(topics, "doc_id").join(asked, "query_id").withColumn("matched", F.bit_count(F.col("m").bitwiseAND(F.col("q"))).cast("long"))
    out = lexical.ranked(rows, F.struct("matched", "bm25_score"), most=5)
    return _cast(out, "rank").select("query_id", "doc_id", "matched", "bm25_score", "rank")


def best_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Of each hit the 320-character window, of windows 280 apart, that holds most of the query's terms."""
    hits = _bm25(spark, sf)
    text = F.col("text")
    at = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / 280).cast("int"))
    asked = _asked(spark, sf).select("query_id", query_terms(F.col("query_text")).alias("terms"))
    pieces = F.transform(at, lambda i: F.struct(i.alias("pos"), text.substr(i * 280 + 1, F.lit(320)).alias("piece")))
    held = _docs(spark, sf).join(hits, "doc_id").select("query_id", "doc_id", F.explode(pieces).alias("p")).select("query_id", "doc_id", "p.pos", "p.piece")
    rows = held.join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("terms", tokenize(F.col("piece")))).cast("long"))
    best = corpus.best_piece(rows.withColumn("hit", F.struct("query_id", "doc_id")), "hit", F.col("shared"), "pos")
    return best.select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"), "shared", F.sha2("piece", 256).alias("piece_sha256"))


def grouped_top3_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as entities: scores relative to the query's best, the three best of each weighted 0.7, 0.2, 0.1."""
    from pyspark.sql import Window

    scores = lexical.bm25(_asked(spark, sf), _docs(spark, sf), gate=False, most=3, by="source")  # parts rank as scores do
    best = lexical.ranked(scores, "bm25_score", ["query_id", "source"], most=3, name="place")
    part = best.withColumn("part", F.round(F.col("bm25_score") / F.max("bm25_score").over(Window.partitionBy("query_id")), 6)).where("part >= 0.05")
    return identity.weighted_best(part, ["query_id", "source"], "part")


def identity_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as identities that two routes rank by first appearance; each route has one vote."""
    source = _docs(spark, sf).select("doc_id", F.col("source").alias("identity"))
    hits = _hybrid(spark, sf, 60)
    route = lambda c: hits.where(F.col(c).isNotNull()).join(source, "doc_id").select("query_id", "identity", F.col(c).alias("rank"))
    from larkfield.operators.domain import diagnose

    return _cast(diagnose(route("bm25_rank"), route("dense_rank")), "rank", "best")


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A document is acceptable for a passage if it holds one of its lines; hit rates and reciprocal ranks at five."""
    line = lambda df, key, text: df.select(F.col(key), F.explode(F.split(text, "\n")).alias("line")).where("length(line) >= 40").distinct()
    gold = line(_docs(spark, sf), "doc_id", "text").join(line(_asked(spark, sf), "query_id", "query_text"), "line").select("query_id", "doc_id")
    return evaluation.metrics(evaluation.first_hits(_asked(spark, sf), _bm25(spark, sf), gold))


# ---- the same in SQL -------------------------------------------------------------------------------

_BM25 = f"""
tok AS (SELECT doc_id, source, lang, {sql_tokens("text")} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(greatest(len(t), 1)) AS avgdl FROM tok),
tf AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, source, lang, greatest(len(t), 1) AS dl, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens("text")})) AS term FROM benchmark),
sc AS (SELECT q.query_id, tf.doc_id, any_value(tf.source) AS source, any_value(tf.lang) AS lang, bool_or({sql_informative("q.term")}) AS informs,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS bm25_score
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, st GROUP BY q.query_id, tf.doc_id)"""


def _sql_top(where: str = "informs", most: int = 5, name: str = "rank") -> str:
    return f"""(SELECT query_id, doc_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS {name} FROM sc WHERE {where} QUALIFY {name} <= {most})"""


_DENSE = """
v AS (SELECT vec_id AS doc_id, embedding AS e FROM embeddings),
ds AS (SELECT a.{q} AS query_id, v.doc_id, round(list_sum(list_transform(list_zip(a.e, v.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS dense_score FROM {qs} a, v),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, doc_id) AS dense_rank FROM ds) WHERE dense_rank <= 30 AND dense_score > 0.15)"""

_HYBRID = f"""WITH {_BM25},
lx AS {_sql_top(most=30, name="bm25_rank")},
""" + _DENSE.format(q="query_id", qs="(SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id IN (SELECT query_id FROM lx))").lstrip() + """,
fu AS (SELECT coalesce(lx.query_id, dn.query_id) AS query_id, coalesce(lx.doc_id, dn.doc_id) AS doc_id, bm25_rank, dense_rank,
  round(0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 6) AS score
  FROM lx FULL JOIN dn ON lx.query_id = dn.query_id AND lx.doc_id = dn.doc_id)"""

_MASK = lambda t: " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower({t}), {chr(39)}{w}{chr(39)})' for w in g)} THEN {1 << i} ELSE 0 END" for i, g in enumerate(GROUPS))

SQL = {
    "token_stats": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
    "informative_terms": f"SELECT item_id AS query_id, array_to_string(list_sort(list_filter(list_distinct({sql_tokens('text')}), lambda w: {sql_informative('w')})), ' ') AS terms FROM benchmark",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM {_sql_top()}",
    "bm25_filtered_topk": f"WITH {_BM25} SELECT * FROM {_sql_top('informs AND lang IN (' + chr(39) + 'de' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ') AND source = ' + chr(39) + 'src3' + chr(39))}",
    "bm25_published": f"WITH {_BM25} SELECT * FROM {_sql_top()}",
    "bm25_published_filtered": f"WITH {_BM25} SELECT * FROM {_sql_top('informs AND lang IN (' + chr(39) + 'de' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ') AND source = ' + chr(39) + 'src3' + chr(39))}",
    "posting_stats": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS top_tf FROM tf GROUP BY term",
    "bm25_empty_filter": f"WITH {_BM25} SELECT * FROM {_sql_top('false')}",
    "lexical_gate": f"WITH {_BM25} SELECT query_id, count(*) AS n_candidates FROM sc WHERE informs GROUP BY 1",
    "dense_topk": "WITH " + _DENSE.format(q="doc_id", qs="(SELECT * FROM v WHERE doc_id % 50 = 0)").lstrip() + " SELECT query_id, doc_id, dense_score, dense_rank FROM dn",
    "vector_validity": """SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim,
  CAST(sum(CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid,
  coalesce(bool_and(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AND min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) > 0, false) AS usable FROM embeddings""",
    "hybrid_rrf": _HYBRID + """ SELECT query_id, doc_id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(dense_rank, 0) AS dense_rank, score, rank, concat_ws('+', CASE WHEN bm25_rank IS NOT NULL THEN 'bm25#' || bm25_rank END, CASE WHEN dense_rank IS NOT NULL THEN 'dense#' || dense_rank END) AS how
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu) WHERE rank <= 5""",
    "overfetch_rerank": f"""WITH {_BM25}, h AS {_sql_top(most=20, name="hit")},
r AS (SELECT h.query_id, h.doc_id, CAST(bit_count(({_MASK('d.text')}) & ({_MASK('b.text')})) AS BIGINT) AS matched, bm25_score FROM h JOIN documents d ON d.doc_id = h.doc_id JOIN benchmark b ON b.item_id = h.query_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, bm25_score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5""",
    "best_snippet": f"""WITH {_BM25}, h AS {_sql_top()},
p AS (SELECT doc_id, pos, substr(text, CAST(pos * 280 + 1 AS BIGINT), 320) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 1, 0) / 280) AS BIGINT) + 1)) AS pos FROM documents)),
a AS (SELECT item_id AS query_id, list_filter(list_distinct({sql_tokens('text')}), lambda w: {sql_informative('w')}) AS terms FROM benchmark)
SELECT h.query_id, h.doc_id, pos, CAST(len(list_intersect(terms, {sql_tokens('piece')})) AS BIGINT) AS shared, sha256(piece) AS piece_sha256
FROM p JOIN h ON h.doc_id = p.doc_id JOIN a ON a.query_id = h.query_id
QUALIFY row_number() OVER (PARTITION BY h.query_id, h.doc_id ORDER BY shared DESC, pos) = 1""",
    "grouped_top3_weighted": f"""WITH {_BM25},
p AS (SELECT query_id, doc_id, source, round(bm25_score / max(bm25_score) OVER (PARTITION BY query_id), 6) AS part FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY part DESC, doc_id) AS k FROM p WHERE part >= 0.05)
SELECT query_id, source, round(least(1.0::DOUBLE, sum(part * CASE k WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 ELSE 0.1 END::DOUBLE)), 4) AS score FROM k WHERE k <= 3 GROUP BY 1, 2""",
    "identity_rrf": _HYBRID + """,
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 60),
ra AS (SELECT query_id, identity, row_number() OVER (PARTITION BY query_id ORDER BY r, identity) AS a FROM (SELECT query_id, source AS identity, min(bm25_rank) AS r FROM ft JOIN documents d ON d.doc_id = ft.doc_id WHERE bm25_rank IS NOT NULL GROUP BY 1, 2)),
rb AS (SELECT query_id, identity, row_number() OVER (PARTITION BY query_id ORDER BY r, identity) AS b FROM (SELECT query_id, source AS identity, min(dense_rank) AS r FROM ft JOIN documents d ON d.doc_id = ft.doc_id WHERE dense_rank IS NOT NULL GROUP BY 1, 2)),
f2 AS (SELECT coalesce(ra.query_id, rb.query_id) AS query_id, coalesce(ra.identity, rb.identity) AS identity,
  round(0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0), 6) AS score, least(a, b) AS best FROM ra FULL JOIN rb ON ra.query_id = rb.query_id AND ra.identity = rb.identity)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, identity) AS rank FROM f2 QUALIFY rank <= 5""",
    "eval_metrics": f"""WITH {_BM25}, h AS {_sql_top()},
dl AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40),
bl AS (SELECT DISTINCT item_id, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) >= 40),
g AS (SELECT DISTINCT item_id, doc_id FROM dl JOIN bl ON dl.line = bl.line),
f AS (SELECT h.query_id, min(rank) AS first_rank FROM h JOIN g ON g.item_id = h.query_id AND g.doc_id = h.doc_id GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3,
  round(avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr
FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) b LEFT JOIN f ON f.query_id = b.query_id""",
}
QUERIES = {name: globals()[name] for name in SQL}
