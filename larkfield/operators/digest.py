"""Digests of sets of rows that don't depend on order, and that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

WORDS = tuple(f"w{k}" for k in range(8))


def row_text(columns: Sequence[str]) -> Column:
    """A row as text that no other row has: ``-`` for null, else the bytes' count, ``:`` and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*map(one, columns))


def states(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, w0..w7): sums of the eight 32-bit words of each row's sha256.

    Tasks add up what they hold, and only the sums are shuffled. Repeated rows count as often as they occur, and the
    sums are exact for up to 10^12 rows.
    """
    hashed = rows.select(*by, F.sha2(row_text(columns), 256).alias("lf_hash"))
    word = lambda k: F.conv(F.substring("lf_hash", 1 + 8 * k, 8), 16, 10).cast("decimal(12,0)")
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(word(k)), F.lit(0)).cast("decimal(22,0)").alias(w) for k, w in enumerate(WORDS)])


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of disjoint parts as those of the whole, so that a day's rows need not be read again."""
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).cast("decimal(22,0)").alias(w) for w in WORDS])


def digests(held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, digest) of states."""
    return held.select(*by, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(w).cast("string") for w in WORDS]), 256).alias("digest"))


def set_digest(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return digests(states(rows, columns, by), by)
