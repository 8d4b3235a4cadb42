"""Retrieval quality: gold joins, hit rates, reciprocal ranks, and checks of citations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_hits(queries: DataFrame, ranked: DataFrame, gold: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", rank: str = "rank") -> DataFrame:
    """(query_id, first_rank): the best rank of an acceptable document; null where none was found."""
    hit = ranked.join(gold.select(query_id, doc_id).distinct(), [query_id, doc_id]).groupBy(query_id).agg(F.min(rank).alias("first_rank"))
    return queries.select(query_id).distinct().join(hit, query_id, "left")


def metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: queries, hit rate at each k, and mean reciprocal rank, to six places."""
    at = lambda k: F.round(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")), 6).alias(f"hit_{k}")
    mrr = F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    return hits.agg(F.count("*").alias("n_queries"), *[at(k) for k in ks], mrr)


def by_category(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("long")).alias("passed"))


def cited_ids(text: Column, pattern: str = r"doc_id=([A-Za-z0-9:_-]+)") -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def unsupported(cited: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Citations that nothing retrieved supports."""
    return cited.select(*keys).distinct().join(retrieved.select(*keys).distinct(), keys, "left_anti")


def evidence_complete(calls: DataFrame, by: str, required: dict[str, Column]) -> DataFrame:
    """(by, complete): every required combination appears among the calls that returned evidence (``has_evidence``)."""
    found = [F.coalesce(F.bool_or(F.col("has_evidence") & c), F.lit(False)) for c in required.values()]
    every = F.lit(True)
    for f in found:
        every = every & f
    return calls.groupBy(by).agg(every.alias("complete"))
