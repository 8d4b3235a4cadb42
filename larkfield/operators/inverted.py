"""An inverted index on disk: written once, read by every search after.

Documents are cut into blocks of bounded size where they lie, inside a task. A posting list holds one term in one block
(places, frequencies, lengths), with the highest frequency and the least length in it, which bound any score it can give. Lists
are stored by bucket of their term, sorted by term, so a search reads only the buckets of its terms, and Parquet's
statistics skip row groups between. Scores need the corpus' statistics, which are a table beside the lists.

A search deals the lists of its terms out by block. A block whose bound for a query is below that query's k-th best
score so far is not scored for it; the k-th best of a share of the blocks is known before the others are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkfield.functions.text import query_terms, tokenize
from larkfield.operators.lexical import B, BLOCK, K1, listed, with_words
from larkfield.runtime import Scratch, ship_package

#: documents of a block; a posting list is never longer
BLOCK_DOCS = 1024
BUCKETS = 64
#: one block in so many is scored first, for the scores that the others have to reach
FIRST = 16
#: blocks from which on that is worth a pass of its own
MANY_BLOCKS = 64
#: scores are compared with what six decimal places may hide
SLACK = 1e-6

_LISTS = [("block", "long"), ("term", "string"), ("slots", "array<int>"), ("tfs", "array<int>"), ("dls", "array<int>"), ("top_tf", "int"), ("low_dl", "int")]
_STORED = {"postings": ", ".join(f"{c} {k}" for c, k in _LISTS) + ", bucket int", "terms": "term string, df long, bucket int"}


def part(tf, dl, mean: float):
    """What a term adds to a BM25 score, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _cut(size: int):
    """(doc_id, text, tokens) of ``with_words`` becomes posting lists, and with a null term the ids and lengths of each block."""

    def lists(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tokens = rows.column(1).combine_chunks()
        dl = np.maximum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False), 1).astype(np.int32)
        coded = tokens.flatten().dictionary_encode()
        width, doc = max(1, len(coded.dictionary)), pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        # by term, then by place in the block
        pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + doc, return_counts=True)
        term, slot = pair // size, (pair % size).astype(np.int32)
        begin = np.searchsorted(term, np.arange(width)) if len(term) else np.zeros(0, np.int64)
        n, offsets = len(begin), pa.array(np.append(begin, len(term)), pa.int32())
        tf = tf.astype(np.int32)
        tops, lows = (np.maximum.reduceat(tf, begin), np.minimum.reduceat(dl[slot], begin)) if n else (tf, tf)
        as_lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
        none = rows.column(0).combine_chunks().slice(0, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), coded.dictionary.cast(pa.string()).slice(0, n), as_lists(slot), as_lists(tf), as_lists(dl[slot]), pa.array(tops, pa.int32()), pa.array(lows, pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), none)],
            names=[*(c for c, _ in _LISTS), "ids"],
        )
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        every = np.arange(len(dl), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([None], pa.string()), one(pa.array(every)), one(pa.array(every)), one(pa.array(dl)), pa.array([0], pa.int32()), pa.array([0], pa.int32()), one(rows.column(0).combine_chunks())],
            names=[*(c for c, _ in _LISTS), "ids"],
        )

    def run(batches):
        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for part, tokens in (piece for batch in batches for piece in listed(batch, size)):
            batch, at = pa.RecordBatch.from_arrays([part.column("doc_id"), tokens], names=["doc_id", "tokens"]), 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - n)
                held.append(piece)
                at, n = at + piece.num_rows, n + piece.num_rows
                if n == size:
                    yield from lists(block, pa.Table.from_batches(held))
                    held, n, block = [], 0, block + 1
        if n:
            yield from lists(block, pa.Table.from_batches(held))

    return run


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> "Index":
    """Writes the index of ``docs`` under ``path`` (which must not exist) and opens it.

    Null ids, texts and titles are fine; documents that repeat count as often as they occur. An empty table gives an
    index that finds nothing. Block numbers come from one pass whose result is written before anything is made of it,
    so lists and ids agree whatever is computed again.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "inverted")
    schema = T.StructType()
    for name, kind in _LISTS:
        schema = schema.add(name, T._parse_datatype_string(kind))
    schema = schema.add("ids", T.ArrayType(docs.schema[id_col].dataType))
    raw = scratch.save(with_words(docs, id_col, text_col, title_col).mapInArrow(_cut(block_docs), schema), "blocks")
    blocks = raw.where("term IS NULL")
    blocks.select("block", "ids", "dls").write.parquet(f"{path}/blocks")
    lists = raw.where("term IS NOT NULL").drop("ids").withColumn("bucket", _bucket(buckets))
    # a term's lists go to one of a few files of its bucket by their block: no term is one task's work
    dealt = lists.repartition("bucket", F.pmod("block", F.lit(8))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    terms = lists.groupBy("bucket", "term").agg(F.sum(F.size("slots")).alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    stats = blocks.agg(F.coalesce(F.sum(F.size("dls")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("total"), F.count("*").alias("blocks"))
    stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/stats")
    scratch.close()
    return Index(spark, path)


class _Asked:
    """Some queries by term, with weights; ``floor`` has the score that each query's documents have to reach."""

    def __init__(self, asked: pa.Table, df: dict[str, int], n: int, mean: float):
        asked = asked.combine_chunks()
        ids, terms = (asked.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        self.ids, self.terms, self.mean = ids.dictionary, terms.dictionary, mean
        at = terms.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        self.query, self.informs = ids.indices.to_numpy()[order], asked.column("informs").to_numpy(zero_copy_only=False)[order].astype(bool)
        self.begin = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        counts = np.array([df.get(t, 0) for t in self.terms.to_pylist()], float)
        self.idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        self.floor = np.zeros(len(self.ids))

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``term``, place in ``query``) of every query that holds each of the terms."""
        n = self.begin[term + 1] - self.begin[term]
        which = np.repeat(np.arange(len(term)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[term], n)


def block_scores(asked: _Asked, rows: pa.Table, most: int | None, gate: bool, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, slot, score) of one block's documents, and the posting lists that were read for it.

    Queries whose bound doesn't reach ``floor`` are left out, and so are the lists that only they ask for. With ``most``
    each query gives its best and their ties.
    """
    term = pc.index_in(rows.column("term"), value_set=asked.terms, skip_nulls=True).combine_chunks()
    rows, term = rows.filter(term.is_valid()), term.drop_null().to_numpy().astype(np.int64)
    top, low = (rows.column(c).to_numpy().astype(float) for c in ("top_tf", "low_dl"))
    which, place = asked.pairs(term)
    bound = np.bincount(asked.query[place], (asked.idf[term] * part(top, low, asked.mean))[which], len(asked.ids))
    live = bound >= floor - SLACK
    live &= bound > 0
    use = live[asked.query[place]]
    read = np.unique(which[use])
    if not len(read):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    lists = rows.take(pa.array(read))
    slots = lists.column("slots").combine_chunks()
    size = pc.list_value_length(slots).to_numpy()
    slot, tf, dl = (lists.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("slots", "tfs", "dls"))
    owner = np.repeat(np.arange(len(read)), size)
    gain = asked.idf[term[read]][owner] * part(tf, dl, asked.mean)
    which, place = asked.pairs(term[read])
    use = live[asked.query[place]]
    which, place = which[use], place[use]
    begin = np.cumsum(size) - size
    n = size[which]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
    # one number for each pair of query and document that share a term
    pair, inverse = np.unique(np.repeat(asked.query[place], n).astype(np.int64) << 32 | slot[at], return_inverse=True)
    score = np.bincount(inverse, gain[at], len(pair))
    query, doc = pair >> 32, pair & 0xFFFFFFFF
    keep = score >= floor[query] - SLACK
    if gate:
        keep &= np.bincount(inverse, np.repeat(asked.informs[place], n).astype(float), len(pair)) > 0
    allowed = rows.schema.metadata and rows.schema.metadata.get(b"allowed")
    if allowed is not None:
        keep &= np.isin(doc, np.frombuffer(allowed, np.int64))
    query, doc, score = query[keep], doc[keep], score[keep]
    if most is not None and len(query):
        order = np.lexsort((-score, query))
        query, doc, score = query[order], doc[order], score[order]
        first = np.searchsorted(query, query)
        last = np.minimum(first + most, np.searchsorted(query, query, "right")) - 1
        keep = score >= score[last] - SLACK
        query, doc, score = query[keep], doc[keep], score[keep]
    return query, doc, score, len(read)


def _scored(asked: _Asked, most: int | None, gate: bool, limited: bool):
    """Posting lists in the order of their blocks become (query_id, block, slot, bm25_score)."""

    def blocks(batches):
        held, key = [], None
        for batch in batches:
            ids = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and ids[a] != key:
                    if held:
                        yield key, pa.Table.from_batches(held)
                    held, key = [], ids[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield key, pa.Table.from_batches(held)

    def run(batches):
        best = [np.zeros(0)] * len(asked.ids)  # of this task, the scores that are among the most of a query
        floor = asked.floor.copy()
        for block, rows in blocks(batches):
            if limited:
                marks = rows.filter(pc.is_null(rows.column("term")))
                if not marks.num_rows:
                    continue
                allowed = np.concatenate([np.asarray(x, np.int64) for x in marks.column("slots").to_pylist()])
                rows = rows.replace_schema_metadata({b"allowed": allowed.tobytes()})
            query, doc, score, _ = block_scores(asked, rows, most, gate, floor)
            if most is not None:
                for q in np.unique(query):
                    got = np.sort(np.append(best[q], score[query == q]))[::-1][:most]
                    best[q] = got
                    if len(got) == most:
                        floor[q] = max(floor[q], got[-1])
            yield pa.RecordBatch.from_arrays(
                [asked.ids.take(pa.array(query)), pa.array(np.full(len(query), block, np.int64)), pa.array(doc.astype(np.int32)), pa.array(score)],
                names=["query_id", "block", "slot", "bm25_score"],
            )

    return run


class Index:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats").first()

    def table(self, name: str) -> DataFrame:
        read = self.spark.read
        if name in _STORED:  # an empty table has no file that could tell
            read = read.schema(_STORED[name])
        return read.parquet(f"{self.path}/{name}")

    def lists(self, terms: list[str], columns: tuple[str, ...] = ()) -> DataFrame:
        """The posting lists of some terms: other buckets are not read."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", _bucket(self.stats.buckets))
        buckets = sorted({r.bucket for r in wanted.select("bucket").distinct().collect()})  # no more than there are buckets
        held = self.table("postings").where(F.col("bucket").isin(buckets))
        return held.join(F.broadcast(wanted.select("term")), "term", "left_semi")  # terms of one block of queries

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents hold each of some terms."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", _bucket(self.stats.buckets))
        buckets = sorted({r.bucket for r in wanted.select("bucket").distinct().collect()})
        held = self.table("terms").where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted.select("term")), "term")
        return {r.term: r.df for r in held.select("term", "df").collect()}  # a row a term of the block of queries

    def bm25(self, queries: DataFrame, candidates: DataFrame | None = None, query_id: str = "query_id", query_text: str = "query_text", id_col: str = "doc_id", gate: bool = True, most: int | None = None) -> DataFrame:
        """(query_id, doc_id, bm25_score) as ``lexical.bm25`` gives it, for the documents of the index.

        ``candidates`` (by ``id_col``) limits what is scored, before any cut; statistics stay those of the corpus. With
        ``most`` a query gives its best only, and ``lexical.ranked`` has to follow. A null id is no candidate.
        """
        spark = self.spark
        ship_package(spark)
        scratch = Scratch(spark, "search")
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term"), query_terms(F.col(query_text)).alias("informative"))
        asked = asked.select("query_id", "term", F.array_contains("informative", F.col("term")).alias("informs"))
        mean = self.stats.total / self.stats.n if self.stats.n else 1.0
        kind = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("bm25_score", T.DoubleType())])
        docs = self.table("blocks").select("block", F.posexplode("ids").alias("slot", "doc_id"))
        marks = None
        if candidates is not None:
            keep = docs.join(candidates.select(F.col(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
            null = {name: F.lit(None).cast(k).alias(name) for name, k in _LISTS}
            marks = keep.groupBy("block").agg(F.collect_list("slot").alias("slots")).select("block", null["term"], "slots", *[null[c] for c, _ in _LISTS[3:]])
            marks = scratch.save(marks, "candidates")
        names, pieces = [c for c, _ in _LISTS], []
        count = max(1, -(-queries.count() // BLOCK))
        for k in range(count):
            mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == k).toArrow()
            terms = pc.unique(mine.column("term")).to_pylist()
            block = _Asked(mine, self.frequencies(terms), self.stats.n, mean)
            lists = self.lists(terms).select(*names)
            if marks is not None:
                lists = lists.join(marks.select("block"), "block", "left_semi").unionByName(marks)
            first = F.pmod(F.xxhash64("block"), F.lit(FIRST)) == 0
            two = most is not None and self.stats.blocks >= MANY_BLOCKS
            for share in ([first, ~first] if two else [F.lit(True)]):
                dealt = lists.where(share).repartition("block").sortWithinPartitions("block")
                got = scratch.save(dealt.mapInArrow(_scored(block, most, gate, marks is not None), kind), "scores")
                pieces.append(got)
                if two and len(pieces) % 2:
                    kth = got.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("bm25_score"), asc=False), 1, most).alias("s")).where(F.size("s") == most)
                    reached = {r.query_id: r.s for r in kth.select("query_id", F.element_at("s", -1).alias("s")).collect()}  # a row a query of the block
                    block.floor = np.array([reached.get(q, 0.0) for q in block.ids.to_pylist()])
        out = pieces[0]
        for piece in pieces[1:]:
            out = out.unionByName(piece)
        return out.join(docs, ["block", "slot"]).select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"))
