"""Product quantisation of vectors by a delta-maintained Lloyd iteration over integers.

Vectors become integers once. A round assigns every part of every vector to the nearest entry of its position's
codebook and writes the assignment beside the one before; running sums and counts of every entry are a small table.
Only parts whose assignment changed contribute to the next sums: plus to the entry they join, minus to the one they
leave, added up inside each task, so that a task shuffles a row for each entry that changed at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larkfield.llm import kernels
from larkfield.runtime import Scratch, read_table, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: integer components have to be smaller: squared distances then fit 64 bits
LIMIT = 1 << 26
#: distances that a task holds at once
CELLS = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


class Codebooks:
    """Entries of every part position, as integers; parts are as equal as the width allows, the first ones longer."""

    def __init__(self, width: int, parts: int, first: np.ndarray):
        sizes = [len(x) for x in np.array_split(np.arange(width), parts)]
        self.cuts = np.cumsum([0, *sizes])
        self.entries = [first[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row and part; ties go to the lower index. All in exact integers."""
        index = np.zeros((len(rows), len(self.entries)), np.int32)
        error = np.zeros(index.shape, np.int64)
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            book, step = self.entries[p], max(1, CELLS // max(1, len(self.entries[p])))
            for at in range(0, len(rows), step):
                x = rows[at : at + step, a:b]
                most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
                if 4 * most * most * max(1, b - a) < 1 << 53:  # doubles hold all sums exactly
                    x, y = x.astype(float), book.astype(float)
                    d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
                else:
                    d = np.zeros((len(x), len(book)), np.int64)
                    for k in range(b - a):
                        d += (x[:, k, None] - book[:, k]) ** 2
                best = d.argmin(1)
                index[at : at + step, p] = best
                error[at : at + step, p] = d[np.arange(len(best)), best].astype(np.int64)
        return index, error

    def moved(self, sums) -> None:
        """Entries become the floor of their parts' means; ``sums`` has (part, entry, count, sums). Unused entries stay."""
        for part, entry, n, total in sums:
            if n:
                book = self.entries[part]
                book[entry] = np.array([int(s) // n for s in total[: book.shape[1]]], np.int64)

    def text(self) -> str:
        return ",".join(str(v) for book in self.entries for v in book.ravel().tolist())


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assign(books: Codebooks, width: int, last: bool):
    """(row, x, code) becomes (row, x, before, code), or with ``last`` (row, code, error)."""

    def run(batches):
        for batch in batches:
            index, error = books.nearest(_lists(batch.column("x"), width))
            code = pa.FixedSizeListArray.from_arrays(pa.array(index.ravel()), index.shape[1]).cast(pa.list_(pa.int32()))
            if last:
                columns = {"row": batch.column("row"), "code": code, "error": pa.array(error.sum(1))}
            else:
                columns = {"row": batch.column("row"), "x": batch.column("x"), "before": batch.column("code"), "code": code}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _changes(cuts: np.ndarray, entries: int):
    """Plus and minus of a task's changed parts: (part, entry, n, s0, s1, ...)."""
    parts, most = len(cuts) - 1, int(np.diff(cuts).max())

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, most), np.int64)
        touched = np.zeros((parts, entries), bool)
        for batch in batches:
            x, code = _lists(batch.column("x"), int(cuts[-1])), _lists(batch.column("code"), parts)
            held = batch.column("before")
            known = held.is_valid().to_numpy(zero_copy_only=False)
            before = np.full(code.shape, -1, np.int64)
            before[known] = _lists(held.filter(held.is_valid()), parts)
            for p in range(parts):
                moved = np.flatnonzero(code[:, p] != before[:, p])
                for sign, to, rows in ((1, code, moved), (-1, before, moved[before[moved, p] >= 0])):
                    at = to[rows, p]
                    np.add.at(n[p], at, sign)
                    np.add.at(sums[p], at, np.pad(sign * x[rows, cuts[p] : cuts[p + 1]], ((0, 0), (0, most - cuts[p + 1] + cuts[p]))))
                    touched[p][at] = True
        part, entry = np.nonzero(touched)
        if len(part):
            columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry])] + [pa.array(sums[part, entry, k]) for k in range(most)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{k}" for k in range(most))])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, scratch: Scratch | None = None) -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks): ``vectors`` without the vector, with ``code`` (an index for each part) and ``error`` at the end, named ``code_1``, ... where taken.

    A component x is floor(scale * x). Codebooks start as the vectors of the ``entries`` smallest ids (rows of one id by
    their vectors, null ids last); with fewer rows there are as many entries. Rows whose vector is null, empty, or
    holds a null or a number that is not finite are dropped, as are those whose length isn't that of the smallest id's:
    they have no distance to it. Equal rows count as often as they occur. An empty table gives (no rows, None).
    Raises ValueError where an integer reaches ``LIMIT``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "codes")
    others = [c for c in vectors.columns if c != vector_col]
    names = []
    for c in ("code", "error"):
        k, name = 0, c
        while name.lower() in {o.lower() for o in others + names}:
            k, name = k + 1, f"{c}_{k + 1}"
        names.append(name)
    ints = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(0).alias("c"))
    held = vectors.where(usable(F.col(vector_col))).select(row.alias("row"), F.col(id_col).alias("id"), ints.alias("x"))
    kept = scratch.save(held, "vectors")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # the starting codebook
    result = T.StructType([T.StructField("row", kept.schema["row"].dataType)]).add("code", T.ArrayType(T.IntegerType())).add("error", "long")
    if not first:
        done, books = spark.createDataFrame([], result), None
    else:
        width = len(first[0].x)
        now = kept.where(F.size("x") == width).select("row", "x", F.lit(None).cast("array<int>").alias("code"))
        most = now.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0]
        if most >= LIMIT:
            raise ValueError(f"components of {most} are beyond {LIMIT}")
        books = Codebooks(width, parts, np.array([r.x for r in first if len(r.x) == width], np.int64))
        state = T.StructType([T.StructField("row", kept.schema["row"].dataType)]).add("x", T.ArrayType(T.LongType())).add("before", T.ArrayType(T.IntegerType())).add("code", T.ArrayType(T.IntegerType()))
        count, size = len(books.entries[0]), int(np.diff(books.cuts).max())
        columns = [f"s{k}" for k in range(size)]
        change = T.StructType().add("part", "integer").add("entry", "integer").add("n", "long")
        for c in columns:
            change = change.add(c, "long")
        sums = None
        for k in range(rounds):
            new = scratch.save(now.mapInArrow(kernels.tidied(_assign(books, width, False)), state), "assigned")
            if k:
                scratch.drop(now)
            now = new
            moved = now.where("before IS NULL OR before <> code").select("x", "before", "code")
            delta = moved.mapInArrow(kernels.tidied(_changes(books.cuts, count)), change)
            added = (delta if sums is None else sums.unionByName(delta)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *columns)])
            sums = scratch.save(added, "sums")
            books.moved((r.part, r.entry, r.n, r[3:]) for r in sums.select("part", "entry", "n", *columns).collect())  # a row for each entry of a codebook
        done = scratch.save(now.mapInArrow(kernels.tidied(_assign(books, width, True)), result), "codes")
    return done.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(others)], F.col("code").alias(names[0]), F.col("error").alias(names[1])), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "codes")
    rows, books = compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), scratch=scratch)
    by_label = scratch.save(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    sha = hashlib.sha256(books.text().encode()).hexdigest() if books else None
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    def assigned(k: int) -> str:  # distance and index in one number, so that ties go to the lower index
        return f"""a{k} AS MATERIALIZED (
  SELECT r, p, m % 65536 AS entry, m // 65536 AS error FROM (
    SELECT q.r, q.p, min(CAST(list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, c.y) + list_inner_product(c.y, c.y) AS BIGINT) * 65536 + c.entry) AS m
    FROM q JOIN c{k} c ON c.p = q.p GROUP BY q.r, q.p)),"""

    def moved(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.entry, coalesce(n.y, c.y) AS y FROM c{k} c LEFT JOIN (
    SELECT p, entry, list(v ORDER BY i) AS y FROM (
      SELECT q.p, a.entry, t.i, floor(sum(q.x[t.i]) / count(*)) AS v
      FROM q JOIN a{k} a ON a.r = q.r AND a.p = q.p, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS i) t WHERE t.i <= len(q.x) GROUP BY ALL) GROUP BY p, entry) n
  ON n.p = c.p AND n.entry = c.entry),"""

    steps = "\n".join(assigned(k) + moved(k) for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS p) t),
c0 AS MATERIALIZED (SELECT p, r - 1 AS entry, x AS y FROM q WHERE r <= {entries}),
{steps}
{assigned(rounds)}
s AS (SELECT sha256(string_agg(CAST(CAST(y[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS h FROM (SELECT p, entry, y, unnest(range(1, len(y) + 1)) AS i FROM c{rounds})),
e AS (SELECT r, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM v JOIN e ON e.r = v.r, s
"""


OP12_SQL = _sql()
