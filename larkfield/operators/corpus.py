"""Corpus hygiene: gate, exact dedupe with provenance, profile, catalog, scope, snippets and samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkfield.functions.text import text_of
from larkfield.operators.filters import contains_any, count_contained
from larkfield.runtime import Scratch


def gate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row of what a build checks: rows, blank or null texts, null ids, surplus rows of repeated ids, null sources."""
    groups = docs.groupBy(id_col).agg(
        F.count("*").alias("n"), F.sum((text_of(F.col(text_col)) == "").cast("long")).alias("blank"), F.sum(F.col(source_col).isNull().cast("long")).alias("nosource")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return groups.agg(
        zero(F.sum("n")).alias("n_docs"), zero(F.sum("blank")).alias("n_blank"), zero(F.sum(F.when(F.col(id_col).isNull(), F.col("n")))).alias("n_no_id"),
        zero(F.sum(F.col("n") - 1)).alias("n_duplicate_ids"), zero(F.sum("nosource")).alias("n_no_source"),
    )


def copies(docs: DataFrame, order_col: str = "doc_id", text_col: str = "text", provenance: Iterable[str] = ("source",)) -> DataFrame:
    """(text_sha256, first, order_col, provenance): a row for every document that isn't blank, with the first id of its text.

    Only ids and provenance move. A text that a third of the documents share is one row of a small table on the other side of
    the join, so Spark splits its copies over tasks.
    """
    text = text_of(F.col(text_col))
    keyed = docs.select(F.sha2(text, 256).alias("text_sha256"), order_col, *provenance).where(text != "")
    first = keyed.groupBy("text_sha256").agg(F.min(order_col).alias("first"))
    first = Scratch(docs.sparkSession, "copies").save(first, "first")  # a plain table, so that the join can be split
    return keyed.join(first, "text_sha256").select("text_sha256", "first", order_col, *provenance)


def dedupe_exact(
    docs: DataFrame, order_col: str = "doc_id", text_col: str = "text", provenance: Iterable[str] = ("source",), max_chars: int | None = None, with_copies: bool = False
) -> DataFrame:
    """The first row of each stripped text, with ``text_sha256``; the copies themselves are rows of ``copies``.

    Blank texts vanish. Texts are cut to ``max_chars`` only after hashing. A row is kept where its id is the least of its
    text, so copies are compared by text and id and never meet in one task. ``with_copies`` also gathers each
    text's later rows in ``also_seen_in`` (id and provenance, in order): for corpora whose groups fit a row.
    """
    text = text_of(F.col(text_col))
    keyed = docs.withColumn("text_sha256", F.sha2(text, 256)).where(text != "")
    first = keyed.groupBy("text_sha256").agg(F.min(order_col).alias(order_col))
    out = keyed.join(first, ["text_sha256", order_col], "left_semi").dropDuplicates(["text_sha256", order_col]).select(*docs.columns, "text_sha256")
    if with_copies:
        later = copies(docs, order_col, text_col, provenance).where(F.col(order_col) != F.col("first"))
        seen = later.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct(order_col, *provenance))).alias("also_seen_in"))
        empty = F.array().cast(seen.schema["also_seen_in"].dataType)
        out = out.join(seen, "text_sha256", "left").withColumn("also_seen_in", F.coalesce("also_seen_in", empty))
    return out if max_chars is None else out.withColumn(text_col, F.substring(text, 1, max_chars))


def profile(docs: DataFrame, *by: str) -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"))


def catalog(docs: DataFrame, source_col: str = "source", kind_col: str = "lang", flag: Column | None = None) -> DataFrame:
    """One row for each source: documents, kinds with their counts as ``kind=n`` in order, and flagged documents."""
    flag = F.lit(False) if flag is None else flag
    by_kind = docs.groupBy(source_col, kind_col).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("flagged"))
    return by_kind.groupBy(source_col).agg(
        F.sum("n").alias("n_docs"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", kind_col, "n"))), ",").alias("kinds"), F.sum("flagged").alias("n_flagged")
    )


def excluded(question: Column, answer: Column, production: Iterable[str], health: Iterable[str]) -> Column:
    """Topical exclusion: intent in the question wins, then its excluded terms, then an answer that has only those."""
    production, health = list(production), list(health)
    return F.when(contains_any(question, production), F.lit(False)).when(contains_any(question, health), F.lit(True)).otherwise(
        contains_any(answer, health) & ~contains_any(answer, production)
    )


def relevance(text: Column, crops: Iterable[str], terms: Iterable[str], strong: Iterable[str]) -> Column:
    """10 and the number of terms where a crop is named; else that number, if two at least and one is strong; else 0."""
    hits = count_contained(text, terms)
    return F.when(contains_any(text, crops), hits + 10).when((hits >= 2) & contains_any(text, strong), hits).otherwise(F.lit(0))


def mask(text: Column, groups: Iterable[Iterable[str]], pattern=None) -> Column:
    """Bit i is set where the text holds a phrase of group i; ``pattern`` makes a regex of a phrase."""
    out = F.lit(0).cast("long")
    for i, group in enumerate(groups):
        hit = F.lit(False)
        for word in group:
            hit = hit | (F.rlike(text, F.lit(pattern(word))) if pattern else F.contains(text, F.lit(word)))
        out = out + F.when(hit, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def best_piece(pieces: DataFrame, group: str, score: Column, position: str, keep: int = 1) -> DataFrame:
    """The ``keep`` best pieces of each group, ties to the earlier one."""
    order = Window.partitionBy(group).orderBy(score.desc(), F.col(position))
    return pieces.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= keep).drop("_k")


def spaced_sample(docs: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """``n`` rows at equal distances in each group's order, ends included; all rows of smaller groups. Rows of one order are one place.

    Places come from counts: keys are dealt by range, each task numbers its own, and what stands before a task is
    summed over tasks. So a group that holds a third of the rows is numbered by many tasks.
    """
    keys = docs.select(by, order).where(F.col(order).isNotNull()).distinct().repartitionByRange(F.col(by).asc_nulls_first(), order)
    keys = Scratch(docs.sparkSession, "sample").save(keys.withColumn("_p", F.spark_partition_id()), "keys")
    sizes = keys.groupBy(by, "_p").agg(F.count("*").alias("_c"))  # a row a group and task
    group = Window.partitionBy(by)
    sizes = sizes.withColumns({"_n": F.sum("_c").over(group), "_before": F.sum("_c").over(group.orderBy("_p")) - F.col("_c")}).withColumnRenamed(by, "_by")
    placed = keys.withColumn("_k", F.row_number().over(Window.partitionBy("_p", by).orderBy(order))).join(
        sizes.withColumnRenamed("_p", "_q"), (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by"))
    )
    at = F.col("_before") + F.col("_k") - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    chosen = placed.where((F.col("_n") <= n) | F.array_contains(places, at)).select(F.col(by).alias("_by"), F.col(order).alias("_order"))
    return docs.join(chosen, F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) == F.col("_order")), "left_semi")
