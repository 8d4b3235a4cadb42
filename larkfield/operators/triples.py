"""Basic graph patterns over a table of triples, as joins that Spark plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PARTS = ("subject", "predicate", "object", "lang")
# The predicates of a thesaurus' preferred and alternative labels.
PREFERRED, ALTERNATIVE = "skos:prefLabel", "skos:altLabel"
#: triples whose concepts one task joins
TASK_ROWS = 250_000


def _bound(triples: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """The bindings of one pattern; terms that begin with ``?`` are variables, all others are constants."""
    seen: dict[str, str] = {}
    rows = triples
    for part, term in zip(PARTS, pattern):
        if not term.startswith("?"):
            rows = rows.where(F.col(part) == term)
        elif term[1:] in seen:
            rows = rows.where(F.col(part) == F.col(seen[term[1:]]))
        else:
            seen[term[1:]] = part
    if not seen:
        raise ValueError(f"no variable in {pattern}")
    return rows.select(*[F.col(part).alias(name) for name, part in seen.items()])


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        raise ValueError(f"no variable in common: {left.columns} and {right.columns}")
    return left.join(right, shared, how)


def match(triples: DataFrame, patterns: Sequence[Sequence[str]], given: DataFrame | None = None) -> DataFrame:
    """A row of bindings for each way in which all patterns hold, repeated as often as there are ways.

    Patterns are (subject, predicate, object) or, where ``triples`` has the column, with ``lang``; they are joined on
    the variables that they share. ``given`` holds bindings to begin with. A pattern that shares no variable with
    what precedes it is refused, as it would be a cross join. Null never binds to another null.
    """
    out = given
    for pattern in patterns:
        found = _bound(triples, pattern)
        out = found if out is None else _joined(out, found, "inner")
    if out is None:
        raise ValueError("no patterns")
    return out


def optional(left: DataFrame, triples: DataFrame, patterns: Sequence[Sequence[str]]) -> DataFrame:
    """Bindings extended where the patterns hold, and kept with nulls where they don't."""
    return _joined(left, match(triples, patterns), "left")


def either(*ways: DataFrame) -> DataFrame:
    """All bindings of each way; variables that a way doesn't bind are null in its rows."""
    out = ways[0]
    for way in ways[1:]:
        out = out.unionByName(way, allowMissingColumns=True)
    return out


def concept_labels(triples: DataFrame, asked: DataFrame, langs: Sequence[str]) -> DataFrame:
    """(label, lang, other_lang, other_label) for ``asked`` (label, lang): the preferred labels, in ``langs``, of concepts that have it.

    A concept has a label if it prefers it or knows it as an alternative, in whatever language. Labels are compared as
    they are. Each row comes once; labels that no concept has get one row with nulls, as a thesaurus' cache keeps what it missed.
    """
    want = asked.select("label", "lang").distinct()
    # stated numbers of partitions, as Spark merges those that are small once compressed, however many rows they sort
    parts = max(1, -(-triples.count() // TASK_ROWS))
    labels = either(*[_bound(triples, ("?concept", p, "?label")) for p in (PREFERRED, ALTERNATIVE)]).withColumn("_salt", F.pmod(F.xxhash64("concept"), F.lit(parts)))
    salted = want.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))  # a label may have a share of all concepts
    named = labels.repartition(parts, "label", "_salt").join(salted.repartition(parts, "label", "_salt").hint("merge"), ["label", "_salt"]).drop("_salt")
    preferred = _bound(triples, ("?concept", PREFERRED, "?other_label", "?other_lang")).where(F.col("other_lang").isin(*langs))
    both = named.repartition(parts, "concept").join(preferred.repartition(parts, "concept").hint("merge"), "concept")
    found = both.select("label", "lang", "other_lang", "other_label").distinct()
    return want.join(found, ["label", "lang"], "left")
