"""Lexical retrieval: corpus statistics, BM25 scores, the lexical gate and ranks, for many queries at once.

Queries are a bounded set and documents are not. So no document's terms are joined with the queries': a block
of queries travels to the documents, with the weights of its terms, and every document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from larkfield.functions.text import plain, plain_words, query_terms, tokenize
from larkfield.runtime import Scratch, ship_package

K1, B = 1.5, 0.75
#: queries that travel at once; every block is one more pass over the documents
BLOCK = 2048
#: scores that a task holds at once, and tokens of the documents that it scores at once, but for longer documents
CELLS, TOKENS = 1 << 19, 1 << 18


def _whole(text_col: str, title_col: str | None) -> Column:
    return F.concat_ws("\n", title_col, text_col) if title_col else F.col(text_col)


def with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc_id, tokens) of the title, a line end and the text."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenize(_whole(text_col, title_col)).alias("tokens"))


def with_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, *carried: str) -> DataFrame:
    """(doc_id, text, tokens, carried) for tasks in Python: a plain text as it is, which ``listed`` cuts up, or the tokens of any other.

    One string moves far faster than its tokens one by one.
    """
    text = F.coalesce(_whole(text_col, title_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *carried).withColumn("_plain", plain(F.col("text")))
    return rows.select("doc_id", F.when(F.col("_plain"), F.col("text")).alias("text"), F.when(~F.col("_plain"), tokenize(F.col("text"))).alias("tokens"), *carried)


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n, avgdl): documents and their mean length. A document without tokens has length 1, an empty corpus mean 1."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.greatest(F.size("tokens"), F.lit(1))), F.lit(1.0)).alias("avgdl"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf); with ``terms`` only for those, which are filtered before anything is shuffled."""
    long = tokens.select("doc_id", F.greatest(F.size("tokens"), F.lit(1)).alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        long = long.join(terms.select("term").distinct(), "term", "left_semi")
    return long.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def _slices(batch: pa.RecordBatch, column: int, rows: int, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``rows`` at most, whose lists in a column have ``TOKENS`` values, or of one row that has more.

    Four bytes of a column ``text`` count as one more value.
    """
    size = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if text is not None:
        size = size + pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False) // 4
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        room = (ends[at - 1] if at else 0) + TOKENS
        n = max(1, min(rows, int(np.searchsorted(ends, room, "right")) - at))
        yield batch.slice(at, n)
        at += n


def listed(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """A batch of ``with_words`` in pieces, each with the tokens of its rows."""
    names = batch.schema.names
    for part in _slices(batch, names.index("tokens"), rows or batch.num_rows, names.index("text")):
        words, tokens = plain_words(part.column("text")), part.column("tokens").cast(pa.list_(pa.string()))
        yield part, words if tokens.null_count == len(tokens) else pc.coalesce(tokens, words)


def _counter(terms: pa.Array):
    """Of a task's documents, how many hold each term; row -1 has their number and the sum of their lengths."""

    def run(batches):
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for lists in (tokens for batch in batches for _, tokens in listed(batch)):
            n, total = n + len(lists), total + int(np.maximum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), 1).sum())
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            held = np.unique(doc[at >= 0].astype(np.int64) * len(terms) + at[at >= 0])
            df += np.bincount(held % max(1, len(terms)), minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n)), pa.array(np.append(np.zeros(len(some), np.int64), total))], names=["term", "df", "dl"]
        )

    return run


class _Block:
    """Some queries by term: the terms, their weights, and which queries hold each of them."""

    def __init__(self, asked: pa.Table, words: DataFrame):
        """``asked`` has query_id, term and informs; ``words`` is what the statistics are counted over, in one pass."""
        asked = asked.combine_chunks()
        ids, terms = (asked.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        self.ids, self.terms = ids.dictionary, terms.dictionary
        at = terms.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        self.query, self.informs = ids.indices.to_numpy()[order], asked.column("informs").to_numpy()[order].astype(float)
        self.begin = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        found = words.select("text", "tokens").mapInArrow(_counter(self.terms), "term int, df long, dl long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).collect()  # a row a term of the block
        df = {r.term: r.df for r in found}
        n, total = df.pop(-1, 0), sum(r.dl for r in found)
        self.mean = total / n if n else 1.0
        counts = np.array([df.get(t, 0) for t in range(len(self.terms))], float)
        self.idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))


def _best(score: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` best scores of each group stand, and what ties with the last of them: the ids decide."""
    order = np.lexsort((-score, group))
    score, group = score[order], group[order]
    last = np.minimum(np.searchsorted(group, group) + most, np.searchsorted(group, group, "right")) - 1
    return order[score >= score[last] - 1e-6]


def _scores(block: _Block, lists: pa.ListArray, gate: bool) -> np.ndarray:
    """Scores of some documents (rows) for the block's queries (columns); 0 where nothing is shared, or nothing that passes the gate."""
    width, queries, rows = len(block.terms), len(block.ids), len(lists)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=block.terms), -1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(rows), size)
    pair, tf = np.unique((doc * width + at)[at >= 0], return_counts=True)
    d, t = pair // width, pair % width
    weight = block.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(size, 1)[d] / block.mean))
    n = block.begin[t + 1] - block.begin[t]
    which = np.repeat(np.arange(len(t)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.begin[t], n)
    cell = d[which] * queries + block.query[place]
    score = np.bincount(cell, weight[which], rows * queries).reshape(rows, queries)
    if gate:
        score[np.bincount(cell, block.informs[place], rows * queries).reshape(rows, queries) == 0] = 0
    return score


def _scorer(block: _Block, most: int | None, gate: bool, by: str | None = None):
    def scored(part: pa.RecordBatch, lists: pa.ListArray):
        score, rows = _scores(block, lists, gate), part.num_rows
        keep = score > 0
        if most is not None and by is None and rows > most:
            keep &= score >= np.partition(score, rows - most, axis=0)[rows - most] - 1e-6  # ties stay for the ids to decide
        row, q = np.nonzero(keep)
        if most is not None and by is not None:
            group = part.column(by).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            best = _best(score[row, q], group[row] * len(block.ids) + q, most)
            row, q = row[best], q[best]
        held = [block.ids.take(pa.array(q)), part.column("doc_id").take(pa.array(row)), pa.array(score[row, q])]
        return pa.RecordBatch.from_arrays(held + ([part.column(by).take(pa.array(row))] if by else []), names=["query_id", "doc_id", "bm25_score"] + ([by] if by else []))

    def run(batches):
        step = max(1, CELLS // max(len(block.ids), 1))
        for batch in batches:
            for part, lists in listed(batch, step):
                yield scored(part, lists)

    return run


def _passing(block: _Block):
    """Of a task's documents, how many pass the gate of each query."""

    def run(batches):
        n = np.zeros(len(block.ids), np.int64)
        for batch in batches:
            for _, lists in listed(batch, max(1, CELLS // max(len(block.ids), 1))):
                n += (_scores(block, lists, True) > 0).sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(some)), pa.array(n[some])], names=["query_id", "n"])

    return run


def _asked(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, term, informs)."""
    asked = queries.select(
        F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term"),
        query_terms(F.col(query_text)).alias("informative"),
    )
    return asked.select("query_id", "term", F.array_contains("informative", F.col("term")).alias("informs"))


def _over_blocks(queries: DataFrame, asked: DataFrame, words: DataFrame, rows: DataFrame, task, fields: list[T.StructField]) -> DataFrame:
    """What ``task`` makes of the rows for each block of queries; statistics are those of ``words``."""
    spark = words.sparkSession
    blocks, out = max(1, -(-queries.count() // BLOCK)), None
    for k in range(blocks):
        block = _Block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow(), words)
        part = rows.mapInArrow(task(block), T.StructType(fields))
        if blocks > 1:  # so the driver holds one block at a time
            part = Scratch(spark, "bm25").save(part, "block")
        out = part if out is None else out.unionByName(part)
    return out


def bm25(
    queries: DataFrame, docs: DataFrame, candidates: DataFrame | None = None, query_id: str = "query_id", query_text: str = "query_text",
    id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, gate: bool = True, most: int | None = None, by: str | None = None,
) -> DataFrame:
    """(query_id, doc_id, bm25_score), rounded to six places, of every candidate that shares a term.

    Statistics come from all of ``docs``; ``candidates`` (a subset by ``id_col``) only limits what is scored.
    With ``gate`` a document has to hold one informative term of the query at least. ``most`` says that no more than
    so many of the best are wanted for each query: each batch then gives these, and ``ranked`` has to follow. With ``by``,
    a column of what is scored that comes along, they are wanted for each query and value of it.
    """
    ship_package(docs.sparkSession)
    carried = [by] if by else []
    words = with_words(docs, id_col, text_col, title_col)
    if candidates is None:
        limited = docs
    elif {text_col, title_col or text_col, *carried} <= set(candidates.columns):
        limited = candidates
    else:
        limited = docs.join(candidates.select(id_col).distinct(), id_col, "left_semi")
    rows = with_words(limited, id_col, text_col, title_col, *carried)
    fields = [T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("bm25_score", T.DoubleType())]
    fields += [T.StructField(c, rows.schema[c].dataType) for c in carried]
    out = _over_blocks(queries, _asked(queries, query_id, query_text), words, rows, lambda block: _scorer(block, most, gate, by), fields)
    return out.withColumn("bm25_score", F.round("bm25_score", 6))


def gated(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "query_text", id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(query_id, n): how many documents pass the gate of each query, counted where they lie."""
    ship_package(docs.sparkSession)
    words = with_words(docs, id_col, text_col, title_col)
    fields = [T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("n", T.LongType())]
    return _over_blocks(queries, _asked(queries, query_id, query_text), words, words, _passing, fields).groupBy("query_id").agg(F.sum("n").alias("n"))


def ranked(scores: DataFrame, score: Column | str, by: str | list[str] = "query_id", tie: str = "doc_id", most: int | None = None, name: str = "rank") -> DataFrame:
    """Adds a rank from 1 by falling score within ``by``, ties by rising ``tie``; keeps the first ``most``."""
    order = Window.partitionBy(by).orderBy(F.desc(score) if isinstance(score, str) else score.desc(), F.col(tie))
    out = scores.withColumn(name, F.row_number().over(order))
    return out if most is None else out.where(F.col(name) <= most)
