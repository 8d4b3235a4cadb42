"""Mixing sources to target weights by hierarchical budgeting.

Weights of a domain-language-source tree are propagated from the root: each node's budget goes to its
children in proportion to their weights, limited by what each subtree can supply in ``max_epochs`` passes.
What a child can't use goes to its siblings first; only what a whole subtree can't use reaches the
siblings of its ancestor. A leaf takes whole epochs and then the token-prefix of one more, in the order of
a seeded hash. The prefix is found from the totals of hash buckets, so a leaf with a third of all rows is
dealt over 4,096 groups. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkfield.runtime import Scratch, read_table

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SALTS = 8
SEED = 20240229
#: production parameters of the query: relative weights, other nodes weigh 1
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2}
MAX_EPOCHS = 2


def domain_of(source: Column) -> Column:
    """``d`` and the source's number modulo 4; ``other`` where it has none."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("d"), (digits.cast("int") % 4).cast("string"))).otherwise("other")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")), F.lit(0)).cast("long")


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``got``: each row's part of its parents' ``budget`` by ``weight``, at most ``cap``, with shortages given to siblings.

    In the order of cap / weight the nodes that are capped come first; for the first node that is not,
    what is left over the weight that is left is the level that all further nodes share.
    """
    rate = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    family = Window.partitionBy(*parents)
    before = family.orderBy(F.col("rate"), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    live = nodes.where("weight > 0 AND cap > 0").withColumn("rate", rate).withColumn("level", level)
    capped = F.col("rate") <= F.col("level")
    shared = F.max(F.when(~capped, F.col("level"))).over(family)
    return live.withColumn("got", F.when(capped, F.col("cap")).otherwise(F.floor(shared * F.col("weight"))).cast("long")).drop("rate", "level")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(domain, lang, source, supply, budget) from leaves (domain, lang, source, supply)."""
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = leaves.agg(F.floor(F.sum("supply") * F.lit(share)).cast("long").alias("budget"))
    level = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # one row
    level = fill(level.withColumn("weight", _weight(F.col("domain"), weights.get("domain", {}))).withColumn("root", F.lit(0)), ["root"], "domain")
    below = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(level.select("domain", F.col("got").alias("budget")), "domain")
    level = fill(below.withColumn("weight", _weight(F.col("lang"), weights.get("lang", {}))), ["domain"], "lang")
    below = caps.join(level.select("domain", "lang", F.col("got").alias("budget")), ["domain", "lang"])
    level = fill(below.withColumn("weight", _weight(F.col("source"), weights.get("source", {}))), ["domain", "lang"], "source")
    return level.select("domain", "lang", "source", "supply", F.col("got").alias("budget"))


def mix(
    docs: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs, last_tokens), one row for each row of ``docs``.

    The budget is ``share`` of all tokens. epochs: how often the whole document is taken; last_tokens:
    how many of its first tokens the last, partial epoch takes. A null language, source or domain is the
    node ``other``; a null or wordless text has no tokens and takes part in nothing. Rows that repeat
    an id each count; ties in the order are between rows that can't be told apart. Rounding loses less
    than one token for each node.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS}
    scratch = Scratch(docs.sparkSession, "mix")
    other = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("other"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), domain_of(F.col(source_col).cast("string")).alias("domain"), other(lang_col).alias("lang"),
        other(source_col).alias("source"), n_tokens(F.col(text_col).cast("string")).alias("n_tokens"),
    )
    rows = scratch.save(rows, "tokens")
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("supply"))
    plan = scratch.save(
        leaf_budgets(leaves, share, max_epochs, weights).select(
            "domain", "lang", "source", F.floor(F.col("budget") / F.col("supply")).cast("long").alias("epochs"),
            (F.col("budget") - F.floor(F.col("budget") / F.col("supply")) * F.col("supply")).cast("long").alias("rest"),
        ), "plan",
    )
    plan = plan.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    keyed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int"))
    keyed = keyed.join(plan, ["domain", "lang", "source", "salt"], "left").drop("salt")
    order = F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.col("doc_id").cast("string")).cast("binary"))
    keyed = keyed.withColumn("h", order).withColumn("bucket", F.substring("h", 1, 3))
    bucket = ["domain", "lang", "source", "bucket"]
    totals = keyed.groupBy(*bucket).agg(F.sum("n_tokens").alias("in_bucket"))
    earlier = Window.partitionBy("domain", "lang", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy(*bucket).orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn("upto", F.sum("n_tokens").over(inside)).join(totals, bucket)
    start = F.col("earlier") + F.col("upto") - F.col("n_tokens")
    taken = F.greatest(F.lit(0), F.least("n_tokens", F.coalesce("rest", F.lit(0)) - start))
    return out.select(
        "doc_id", "domain", "lang", "source", "n_tokens", F.when(F.col("n_tokens") > 0, F.coalesce("epochs", F.lit(0))).otherwise(0).cast("long").alias("epochs"),
        taken.cast("long").alias("last_tokens"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{1,9}$') THEN 'd' || (CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER) % 4) ELSE 'other' END AS domain,
    coalesce(lang, 'other') AS lang, coalesce(source, 'other') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS supply, CAST(sum(n) * 2 AS BIGINT) AS cap FROM t GROUP BY ALL HAVING sum(n) > 0),
d0 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (SELECT sum(supply) FROM leaf) AS budget FROM leaf GROUP BY domain),
d1 AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl, cap::DOUBLE / w AS rate FROM d0
  WINDOW b AS (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT domain, CAST(CASE WHEN rate <= lvl THEN cap ELSE floor(max(CASE WHEN rate > lvl THEN lvl END) OVER () * w) END AS BIGINT) AS budget FROM d1),
l0 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 6.0 WHEN 'de' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM leaf GROUP BY domain, lang),
l1 AS (SELECT l0.*, (budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER (PARTITION BY l0.domain) - coalesce(sum(w) OVER b, 0)) AS lvl, cap::DOUBLE / w AS rate FROM l0 JOIN d2 ON d2.domain = l0.domain
  WINDOW b AS (PARTITION BY l0.domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT domain, lang, CAST(CASE WHEN rate <= lvl THEN cap ELSE floor(max(CASE WHEN rate > lvl THEN lvl END) OVER (PARTITION BY domain) * w) END AS BIGINT) AS budget FROM l1),
s1 AS (SELECT leaf.*, (budget - coalesce(sum(cap) OVER b, 0))::DOUBLE / (count(*) OVER (PARTITION BY leaf.domain, leaf.lang) - coalesce(count(*) OVER b, 0)) AS lvl, cap::DOUBLE AS rate FROM leaf JOIN l2 ON l2.domain = leaf.domain AND l2.lang = leaf.lang
  WINDOW b AS (PARTITION BY leaf.domain, leaf.lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT domain, lang, source, supply, CAST(CASE WHEN rate <= lvl THEN cap ELSE floor(max(CASE WHEN rate > lvl THEN lvl END) OVER (PARTITION BY domain, lang)) END AS BIGINT) AS budget FROM s1),
p AS (SELECT domain, lang, source, budget // supply AS epochs, budget % supply AS rest FROM s2),
k AS (SELECT t.*, coalesce(p.epochs, 0) AS epochs, coalesce(p.rest, 0) AS rest, md5('20240229:' || coalesce(p.epochs, 0) || ':' || t.doc_id) AS h
  FROM t LEFT JOIN p ON p.domain = t.domain AND p.lang = t.lang AND p.source = t.source),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(CASE WHEN n > 0 THEN epochs ELSE 0 END AS BIGINT) AS epochs,
  CAST(greatest(0, least(n, rest - before)) AS BIGINT) AS last_tokens FROM u
"""
