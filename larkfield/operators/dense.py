"""Dense retrieval by cosine over unit vectors, in blocks of queries against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from larkfield.functions.vector import is_valid
from larkfield.operators.lexical import ranked
from larkfield.runtime import Scratch, ship_package

CANDIDATES, LEAST = 30, 0.15
#: query vectors that are held at once
BLOCK = 4096
#: scores that a task holds at once
CELLS = 1 << 19


def validity(vectors: DataFrame, vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """One row: rows, width (least and most), rows that are invalid, and whether the dense branch may run."""
    size = F.size(vector_col)
    ok = is_valid(F.col(vector_col), dim) if dim else is_valid(F.col(vector_col), size)
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"),
        F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("n_invalid"),
        F.coalesce(F.bool_and(ok) & (F.min(size) == F.max(size)) & (F.min(size) > 0), F.lit(False)).alias("usable"),
    )


def _nearest(ids: pa.Array, matrix: np.ndarray, most: int):
    """The ``most`` best rows of a partition for each query of a block, kept while the batches go by."""

    def run(batches):
        best_score, best_id, kind = [np.zeros(0)] * len(matrix), [None] * len(matrix), pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            width = np.array(batch.column(1).value_lengths().fill_null(-1))
            fits = np.flatnonzero(width == matrix.shape[1])
            rows = batch.take(pa.array(fits))
            key = rows.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")  # ties go to the lesser id, as every further sort is stable
            values = np.asarray(rows.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(fits), matrix.shape[1])[order]
            key = key[order]
            step = max(1, CELLS // len(matrix))
            for at in range(0, len(values), step):
                scores, names = np.round(values[at : at + step] @ matrix.T, 6), key[at : at + step]
                scores[np.isnan(scores)] = -np.inf
                for q in range(len(matrix)):
                    top = np.argsort(-scores[:, q], kind="stable")[:most]
                    s, i = scores[top, q], names[top]
                    if best_id[q] is not None:
                        s, i = np.concatenate([best_score[q], s]), np.concatenate([best_id[q], i])
                        by_id = np.argsort(i, kind="stable")
                        top = by_id[np.argsort(-s[by_id], kind="stable")[:most]]
                        s, i = s[top], i[top]
                    best_score[q], best_id[q] = s, i
        for q in range(len(matrix)):
            if best_id[q] is not None and len(best_id[q]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[q].as_py()] * len(best_id[q]), ids.type), pa.array(best_id[q], kind), pa.array(best_score[q])], names=["query_id", "doc_id", "dense_score"]
                )

    return run


def dense_top(
    queries: DataFrame, vectors: DataFrame, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "doc_id",
    vector_col: str = "embedding", most: int = CANDIDATES, least: float = LEAST,
) -> DataFrame:
    """(query_id, doc_id, dense_score, dense_rank): the ``most`` nearest, and of those the ones over ``least``.

    Queries are a stated set that meets all rows in blocks of ``BLOCK`` vectors: each block goes to the
    rows, and every partition sends its ``most`` best for each query, so no row is made for a pair. Rows of
    another width than the block's are skipped; scores are rounded to six places before they are ranked.
    """
    ship_package(vectors.sparkSession)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([asked.schema["query_id"], rows.schema["doc_id"], T.StructField("dense_score", T.DoubleType())])
    sizes = {r.n: r.c for r in asked.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).collect()}  # one row a width
    found = vectors.sparkSession.createDataFrame([], schema)
    for width, n in sorted(sizes.items()):
        blocks = -(-n // BLOCK)
        for k in range(blocks):
            part = asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow()
            matrix = np.array(part.column("v").to_pylist(), np.float64).reshape(part.num_rows, width)
            ids = part.column("query_id").combine_chunks()
            part = rows.mapInArrow(_nearest(ids, matrix, most), schema)
            if blocks > 1:  # so the driver holds one block at a time
                part = Scratch(vectors.sparkSession, "dense").save(part, "block")
            found = found.unionByName(part)
    top = ranked(found, "dense_score", most=most, name="dense_rank")
    return top.where(F.col("dense_score") > max(0.0, least))
