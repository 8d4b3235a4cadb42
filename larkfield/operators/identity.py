"""Identity joins that refuse ambiguous answers, dictionary scans, and alias tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkfield.functions.text import label_pattern, normalize, normalize_text
from larkfield.operators.components import connected_components
from larkfield.runtime import Scratch


def alias_index(labels: DataFrame, term: str = "term_id", label: str = "label", order: str = "ord", preferred: Column | None = None) -> DataFrame:
    """(norm_label, term_id): each normalised label of two characters or more belongs to one term.

    Preferred terms come first, then the least ``order``, then the least term.
    """
    first = (F.lit(0) if preferred is None else F.when(preferred, 0).otherwise(1)).alias("_p")
    rows = labels.select(normalize(F.col(label)).alias("norm_label"), F.struct(first, F.col(order).alias("_o"), F.col(term).alias("_t")).alias("_s"))
    return rows.where(F.length("norm_label") >= 2).groupBy("norm_label").agg(F.min("_s").alias("_s")).select("norm_label", F.col("_s._t").alias("term_id"))


def merge_terms(labels: DataFrame, term: str = "term_id", lang: str = "lang", label: str = "label", order: str = "ord") -> DataFrame:
    """(term_id, lang, labels): distinct labels of each term and language in order of first appearance."""
    first = labels.groupBy(term, lang, label).agg(F.min(order).alias("_o"))
    packed = first.groupBy(term, lang).agg(F.array_sort(F.collect_list(F.struct("_o", label))).alias("_l"))
    return packed.select(F.col(term).alias("term_id"), F.col(lang).alias("lang"), F.transform("_l", lambda x: x[label]).alias("labels"))


def expand_labels(asked: DataFrame, index: DataFrame, merged: DataFrame, langs: Iterable[str]) -> DataFrame:
    """(query_id, label): all labels in the wanted languages of the term that each asked ``label`` names."""
    hit = asked.select("query_id", normalize(F.col("label")).alias("norm_label")).join(index, "norm_label")
    return hit.join(merged.where(F.col("lang").isin(list(langs))), "term_id").select("query_id", F.explode("labels").alias("label")).distinct()


def alias_groups(pairs: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(name, group_id): names that pairs tie together; the id is the least name.

    Names are compared by a 64-bit hash while components are found.
    """
    names = pairs.select(F.explode(F.array(a, b)).alias("name")).where("name is not null").distinct().withColumn("node", F.xxhash64("name"))
    found = connected_components(pairs.select(F.xxhash64(a).alias("a"), F.xxhash64(b).alias("b")), scratch)
    rows = names.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rows.groupBy("root").agg(F.min("name").alias("group_id"))
    return rows.join(least, "root").select("name", "group_id")


def unique_or_nothing(matches: DataFrame, by: str, target: str) -> DataFrame:
    """The one distinct target of each key; keys with several are refused."""
    return matches.groupBy(by).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def link_with_fallback(first: DataFrame, second: DataFrame, by: str, target: str) -> DataFrame:
    """``unique_or_nothing`` over the first route; the second counts only for keys without any row in the first.

    Rows have to be filtered by scope before: a key with only foreign rows in the first route falls back.
    """
    rest = second.join(first.select(by).distinct(), by, "left_anti")
    return unique_or_nothing(first.select(by, target).unionByName(rest.select(by, target)), by, target)


def any_of(left: DataFrame, right: DataFrame, left_id: str, right_id: str, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id) where any of the column pairs is equal: a union of equi-joins, never a nested loop."""
    out = None
    for a, b in pairs:
        part = left.select(F.col(left_id), F.col(a).alias("_k")).join(right.select(F.col(right_id), F.col(b).alias("_k")), "_k").select(left_id, right_id)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def ambiguous(matches: DataFrame, by: str, scope: str) -> DataFrame:
    """(by, n_scopes, refused): refused where the matches of a key lie in more than one scope."""
    return matches.groupBy(by).agg(F.count_distinct(scope).alias("n_scopes")).withColumn("refused", F.col("n_scopes") > 1)


def dictionary_scan(texts: DataFrame, words: Iterable[str], id_col: str = "doc_id", text_col: str = "text", bounded: bool = True) -> DataFrame:
    """(id, word): the dictionary words that each normalised text names, longest alternatives first.

    One alternation over the whole dictionary, so a text is read once; the dictionary is a short list. ``scan`` has automata
    for dictionaries that are tables.
    """
    ordered = sorted({normalize_text(w) for w in words if w}, key=lambda w: (-len(w), w))
    pattern = "|".join(label_pattern(w) if bounded else w for w in ordered) or "(?!)"
    found = F.array_distinct(F.regexp_extract_all(normalize(F.col(text_col)), F.lit(pattern), F.lit(0)))
    return texts.select(F.col(id_col), F.explode(found).alias("word"))


def holds(rows: DataFrame, column: str, wanted: str) -> Column:
    """Whether a column, or one of its values where it is an array, is ``wanted`` after normalisation."""
    if dict(rows.dtypes)[column].startswith("array"):
        return F.exists(F.col(column), lambda x: normalize(x.cast("string")) == wanted)
    return normalize(F.col(column).cast("string")) == wanted


def exact_records(rows: DataFrame, keys: dict[str | tuple[str, ...], str], order: Iterable[str], template: Column | None = None, demo: Column | None = None, top_k: int = 5) -> DataFrame:
    """Rows whose normalised keys equal the wanted ones; no templates, demonstration rows last. A blank key finds nothing.

    A key may be several columns, of which one has to hold the value; columns may be arrays.
    """
    out = rows
    for columns, wanted in keys.items():
        wanted, any_of_them = normalize_text(wanted), F.lit(False)
        for column in (columns,) if isinstance(columns, str) else columns:
            any_of_them = any_of_them | F.coalesce(holds(rows, column, wanted), F.lit(False))
        out = out.where(any_of_them if wanted else F.lit(False))
    if template is not None:
        out = out.where(~template)
    return out.orderBy(F.lit(False) if demo is None else demo, *order).limit(max(top_k, 0))


def first_rank(hits: DataFrame, query: str, identity: str, rank: str) -> DataFrame:
    """Ranks identities by their first appearance among the hits."""
    best = hits.groupBy(query, identity).agg(F.min(rank).alias("_r"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_r", identity))).drop("_r")


def weighted_best(rows: DataFrame, by: list[str], score: str, weights: tuple[float, ...] = (0.7, 0.2, 0.1), tie: str = "doc_id") -> DataFrame:
    """Weighted sum of the best few scores of each group, at most 1, to four places."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_k"))
    top = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= len(weights))
    return top.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.sum(F.col(score) * weight)), 4).alias("score"))
