"""Candidate filters that apply before any ranking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.functions import nested
from larkfield.functions.text import normalize, normalize_text


def meta_table(docs: DataFrame, id_col: str, keys: Iterable[str]) -> DataFrame:
    """(doc_id, key, value): the normalised values of each metadata key; scalars and arrays alike, nulls and blanks dropped."""
    kinds = dict(docs.dtypes)
    parts = []
    for key in keys:
        values = F.col(key) if kinds[key].startswith("array") else F.array(key)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(key).alias("key"), F.explode(values).alias("value"))
        parts.append(rows.withColumn("value", normalize(F.col("value").cast("string"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value <> ''").distinct()


def allowed(
    docs: DataFrame, columns: Mapping[str, Iterable[str] | str | None] | None = None,
    meta: Mapping[str, Iterable[str] | str] | None = None, ids: Iterable | DataFrame | None = None, id_col: str = "doc_id",
    nested_col: str = "meta",
) -> DataFrame:
    """The candidates: and over keys, or within a key. None means no filter, an empty list lets nothing through.

    ``columns`` compares plain columns exactly. ``meta`` compares normalised values of scalar or array
    columns, and a row without the key never matches. Where ``nested_col`` is a variant, keys that are no columns are
    dotted paths in it (``measurements.EC.value``), and what copies of a text keep counts too. ``ids`` may be a DataFrame with the column ``id_col``.
    """
    out = docs
    for key, wanted in (columns or {}).items():
        if wanted is not None:
            values = [wanted] if isinstance(wanted, str) else list(wanted)
            out = out.where(F.col(key).isin(values) if values else F.lit(False))
    kinds = dict(docs.dtypes)
    for key, wanted in (meta or {}).items():
        if key not in kinds and kinds.get(nested_col) == "variant":
            out = out.where(nested.holds(F.col(nested_col), key, wanted))
            continue
        values = [normalize_text(v) for v in ([wanted] if isinstance(wanted, str) else wanted)]
        if not values:
            out = out.where(F.lit(False))
        elif kinds[key].startswith("array"):
            held = F.transform(F.col(key), lambda x: normalize(x.cast("string")))
            out = out.where(F.arrays_overlap(held, F.array(*map(F.lit, values))))
        else:
            out = out.where(F.col(key).isNotNull() & normalize(F.col(key).cast("string")).isin(values))
    if isinstance(ids, DataFrame):
        out = out.join(ids.select(id_col).distinct(), id_col, "left_semi")
    elif ids is not None:
        ids = list(ids)
        out = out.where(F.col(id_col).isin(ids) if ids else F.lit(False))
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def count_contained(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(0)
    for word in words:
        out = out + F.contains(text, F.lit(word)).cast("int")
    return out
