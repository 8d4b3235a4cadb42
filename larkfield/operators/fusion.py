"""Reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.functions.text import normalize
from larkfield.operators.dense import dense_top
from larkfield.operators.inverted import Index
from larkfield.operators.lexical import bm25, ranked
from larkfield.runtime import Scratch

RRF = 60


def rrf(*ranks: Column) -> Column:
    """Sum of 1 / (60 + rank) over the lists that hold the row; ranks count from 1."""
    out = F.lit(0.0)
    for rank in ranks:
        out = out + F.coalesce(F.lit(1.0) / (RRF + rank), F.lit(0.0))
    return F.round(out, 6)


def how(bm25_rank: Column, dense_rank: Column) -> Column:
    """Which lists hold the row, such as ``bm25#1+dense#4``."""
    return F.concat_ws("+", F.when(bm25_rank.isNotNull(), F.concat(F.lit("bm25#"), bm25_rank)), F.when(dense_rank.isNotNull(), F.concat(F.lit("dense#"), dense_rank)))


def fuse(lexical: DataFrame, dense: DataFrame, top_k: int, titles: DataFrame | None = None) -> DataFrame:
    """Full outer join of two ranked lists, scored by rank; equal titles first, then score, then id.

    ``lexical`` has bm25_rank and ``dense`` has dense_rank; ``titles`` may give (query_id, doc_id) pairs
    whose title equals the query.
    """
    both = lexical.join(dense, ["query_id", "doc_id"], "full_outer").withColumn("score", rrf(F.col("bm25_rank"), F.col("dense_rank")))
    first = F.lit(0)
    if titles is not None:
        both = both.join(titles.withColumn("_exact", F.lit(1)), ["query_id", "doc_id"], "left")
        first = F.coalesce("_exact", F.lit(0))
    order = F.struct(first, F.col("score"))
    out = ranked(both, order, most=top_k).withColumn("how", how(F.col("bm25_rank"), F.col("dense_rank")))
    return out.drop("_exact")


def hybrid_search(
    queries: DataFrame, docs: DataFrame, vectors: DataFrame | None = None, candidates: DataFrame | None = None, top_k: int = 5,
    candidate_k: int = 30, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, index: Index | None = None,
) -> DataFrame:
    """Filter, gate, rank by BM25 and cosine, fuse, cut. ``queries`` has query_id, query_text and perhaps query_vector.

    A query without any gated lexical hit returns nothing, however close a vector may be. With an ``index`` of the
    documents no text is read.
    """
    if index is None:
        lexical = bm25(queries, docs, candidates, id_col=id_col, text_col=text_col, title_col=title_col, most=candidate_k)
    else:
        lexical = index.bm25(queries, candidates, id_col=id_col, most=candidate_k)
    # a few rows a query, read by the dense branch and by the fusion: written once rather than scored again
    lexical = Scratch(docs.sparkSession, "lexical").save(ranked(lexical, "bm25_score", most=candidate_k, name="bm25_rank"), "ranked")
    if vectors is None:
        dense = lexical.select("query_id", "doc_id").where(F.lit(False)).withColumn("dense_score", F.lit(0.0)).withColumn("dense_rank", F.lit(0))
    else:
        rows = vectors if candidates is None else vectors.join(candidates.select(id_col).distinct(), id_col, "left_semi")
        dense = dense_top(queries.join(lexical.select("query_id").distinct(), "query_id", "left_semi"), rows, id_col=id_col, most=candidate_k)
    titles = None
    if title_col:
        named = docs.select(F.col(id_col).alias("doc_id"), normalize(F.col(title_col)).alias("_t"))
        asked = queries.select("query_id", normalize(F.col("query_text")).alias("_t"))
        titles = named.join(asked, "_t").select("query_id", "doc_id").distinct()
    return fuse(lexical, dense, top_k, titles)
