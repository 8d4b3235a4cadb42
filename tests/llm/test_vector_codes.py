import math
import random

import numpy as np
import pytest

from larkfield.llm import vector_codes as v


def brute(rows, parts, entries, rounds):
    """Plain loops over (id, vector)."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cut = [d * p // parts for p in range(parts + 1)]
    books = [[x[cut[p] : cut[p + 1]] for _, x in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j: (dist(x[cut[p] : cut[p + 1]], books[p][j]), j)) for p in range(parts)] for _, x in kept]
        if k < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [x[cut[p] : cut[p + 1]] for (_, x), c in zip(kept, codes) if c[p] == j]
                    if mine:
                        books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(dist(x[cut[p] : cut[p + 1]], books[p][c[p]]) for p in range(parts)) for (_, x), c in zip(kept, codes)]
    return sorted((str(i), tuple(c), e) for (i, _), c, e in zip(kept, codes, errors)), books


@pytest.mark.parametrize("big", [1, 12_000])
def test_same_as_brute_force(spark, big):
    rng = random.Random(5)
    rows = [(i, [rng.choice([rng.gauss(0, big), 0.0, -0.25]) for _ in range(8)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 60 + [(None, [1.0] * 8), (200, None), (201, []), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, code string, ERROR int").repartition(3)
    out, books = v.compress(df, entries=12, rounds=3)
    assert out.columns == ["vec_id", "code", "ERROR", "code_1", "error_1"]
    want, found = brute(rows, 4, 12, 3)
    assert sorted((str(r.vec_id), tuple(r.code_1), r.error_1) for r in out.collect()) == want
    assert [b.tolist() for b in books.entries] == found


def test_only_changed_parts_move(spark):
    """Sums come from plus and minus alone: a round in which nothing changes shuffles nothing, and sums stay right."""
    books = v.Codebooks(4, 2, np.array([[0, 0, 0, 0], [9, 9, 9, 9]]))
    import pyarrow as pa

    def batch(before, code):
        return pa.RecordBatch.from_pydict({"x": pa.array([[1, 1, 8, 8]], pa.list_(pa.int64())), "before": pa.array([before], pa.list_(pa.int32())), "code": pa.array([code], pa.list_(pa.int32()))})

    run = v._changes(books.cuts, 2)
    assert list(run([batch([0, 1], [0, 1])])) == []
    got = [r for b in run([batch([0, 0], [0, 1])]) for r in b.to_pylist()]
    assert got == [{"part": 1, "entry": 0, "n": -1, "s0": -8, "s1": -8}, {"part": 1, "entry": 1, "n": 1, "s0": 8, "s1": 8}]
    assert [r["entry"] for b in run([batch(None, [0, 1])]) for r in b.to_pylist()] == [0, 1]


def test_ties_few_rows_and_other_lengths(spark):
    rows = [(3, [0.0, 0.0, 0.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0, 0.0, 1.0]), (2, [1.0]), (4, [0.5] * 5)]
    out, books = v.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id, r.code[0], r.error) for r in out.collect())[0] == (1, 0, 0)
    assert len(out.collect()) == 3 and [b.shape for b in books.entries] == [(3, 2), (3, 1), (3, 1), (3, 1)]


def test_too_large(spark):
    with pytest.raises(ValueError):
        v.compress(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"))


def test_empty(spark):
    out, books = v.compress(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))
    assert out.collect() == [] and books is None and out.columns == ["vec_id", "code", "error"]
