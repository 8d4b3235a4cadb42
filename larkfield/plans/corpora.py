"""Corpus, identity and text queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.functions import text as tx
from larkfield.functions.nfkc import nfd
from larkfield.functions.vector import hash_embed
from larkfield.operators import corpus, identity, kg, scan, series, terms
from larkfield.plans.retrieval import GROUPS, _MASK, sql_tokens
from larkfield.runtime import Scratch, read_table

#: words of the invented prose that stand in for topical vocabulary
PRODUCTION, HEALTH = ("heit", "ción"), ("eaux", "thing")
CROPS, TERMS, STRONG = ("oing", "eneux"), ("tion", "ment", "keit", "anan", "erer"), ("keit", "ment")
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
WORDS = ("the", "thing", "under", "license", "version", "public", "apache", "gnu", "general", "token")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def doc_profile(spark, sf):
    return corpus.profile(_docs(spark, sf), "source", "lang")


def doc_catalog(spark, sf):
    """Documents that labels call toxic are flagged; documents without labels are not."""
    labels = read_table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad")).distinct()
    return corpus.catalog(_docs(spark, sf).join(labels, "doc_id", "left"), flag=F.coalesce("bad", F.lit(False)))


def dedupe_exact(spark, sf):
    return corpus.dedupe_exact(_docs(spark, sf)).select("doc_id", "text_sha256")


def exact_copies(spark, sf):
    """Every document with the first of its text."""
    return corpus.copies(_docs(spark, sf)).select("doc_id", "first", "source")


def dedupe_provenance_filter(spark, sf):
    """Kept documents that source src3 holds, be it by a later copy."""
    held = corpus.copies(_docs(spark, sf)).where("source = 'src3'").select(F.col("first").alias("doc_id")).distinct()
    return corpus.dedupe_exact(_docs(spark, sf).select("doc_id", "source", "text")).join(held, "doc_id", "left_semi").select("doc_id", "source")


def full_width_tokens(spark, sf):
    """Tokens of the documents written in full-width letters: those of the plain text."""
    wide = F.translate("text", _ASCII, "".join(chr(ord(c) + 0xFEE0) for c in _ASCII))
    return _docs(spark, sf).select("doc_id", F.array_join(tx.tokenize(wide), " ").alias("tokens"))


def composed_text(spark, sf):
    """Documents with their accented letters taken apart, and typographic forms put in: normalised they are the plain text."""
    text = tx.normalize(F.concat(F.lit("\ufb01\u00bd\u3314 "), F.col("apart")))
    rows = _docs(spark, sf).select("doc_id", nfd(F.col("text")).alias("apart"))  # used twice and computed once
    return rows.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.size(tx.tokenize(F.col("apart"))).cast("long").alias("n_tokens"))


def label_places(spark, sf):
    """Label matches of the dictionary in passages: how many places each has."""
    labels = terms.dictionary(spark, {w: [w] for w in WORDS})
    asked = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tx.normalize(F.col("text")).alias("text"))
    return terms.occurrences(asked, labels).select("query_id", F.col("key").alias("word"), F.size("spans").cast("long").alias("n"))


def site_pairs(spark, sf):
    """Nations and regions whose names hold each other's letters: the related-crops join by parts of names."""
    n = read_table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return kg.related_crops(n, n.select(F.substring("name", 1, 3).alias("crop")))


def cumulative_daily(spark, sf):
    """Order counts of a day and so far, by priority."""
    rows = read_table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.count("*").alias("n"))
    out = series.cumulative(rows, ["o_orderpriority"], "o_orderdate", "n")
    return out.select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("so_far").cast("long").alias("so_far"))


def quality_gate(spark, sf):
    return corpus.gate(_docs(spark, sf))


def relevance_filter(spark, sf):
    """The first line is the question, the rest the answer."""
    text = F.lower("text")
    q = F.substring_index(text, "\n", 1)
    a = text.substr(F.length(q) + 1, F.length(text))
    return _docs(spark, sf).select("doc_id", corpus.excluded(q, a, PRODUCTION, HEALTH).alias("excluded"), corpus.relevance(text, CROPS, TERMS, STRONG).cast("long").alias("relevance"))


def topic_bitmask(spark, sf):
    m = corpus.mask(F.lower("text"), GROUPS)
    return _docs(spark, sf).groupBy(m.alias("mask")).agg(F.count("*").alias("n_docs")).withColumn("n_topics", F.bit_count("mask").cast("long"))


def stratified_sample(spark, sf):
    return corpus.spaced_sample(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 7)


def union_sources(spark, sf):
    docs = _docs(spark, sf).select(F.lit("documents").alias("origin"), F.length("text").cast("long").alias("n"))
    pages = read_table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.length("html").cast("long").alias("n"))
    return docs.unionByName(pages).groupBy("origin").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_chars"))


def dictionary_scan(spark, sf):
    return identity.dictionary_scan(_docs(spark, sf), WORDS)


def label_scan(spark, sf):
    """Every word of the documents and every pair of neighbouring words of the passages as labels, all of their places in all documents."""
    words = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(tx.normalize(F.col(t)), F.lit("[a-z0-9]{2,}"), F.lit(0))))
    one = _docs(spark, sf).select(words("text").alias("label"))
    pieces = F.split(tx.normalize(F.col("text")), " ")
    both = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat_ws(" ", F.regexp_extract(F.element_at("p", i), "[a-z0-9]+$", 0), F.regexp_extract(F.element_at("p", i + 1), "^[a-z0-9]+", 0)))
    two = read_table(spark, sf, "benchmark").select(pieces.alias("p")).where("size(p) > 1").select(F.explode(both).alias("label")).where(F.rlike("label", F.lit("^[a-z0-9]+ [a-z0-9]+$")))
    found = scan.find_labels(_docs(spark, sf).select("doc_id", "text"), one.unionByName(two))
    longest = F.array_max(F.transform("found", lambda x: F.struct(F.length(x["label"]).alias("n"), x["label"].alias("label"))))["label"]
    rows = found.where("size(found) > 0")
    label = F.transform("found", lambda x: x["label"])
    return rows.select("doc_id", F.size("found").cast("long").alias("n_places"), F.size(F.array_distinct(label)).cast("long").alias("n_labels"), longest.alias("longest"))


def entity_scan(spark, sf):
    """Parts as entities, each word of their names a label: which brands of parts a document's words name, the longest first."""
    names = read_table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.explode(F.split("p_name", " ")).alias("label"))
    return scan.find_entities(_docs(spark, sf), names).withColumn("rank", F.col("rank").cast("long"))


def text_functions(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", tx.snippet(t, 100).alias("snippet"), tx.clip(t, 60).alias("clip"), tx.safe_component(F.concat("source", F.lit("/../"), "lang")).alias("path"),
        tx.thread_id(F.col("source"), F.lit("2024-01-05"), F.col("lang")).alias("thread"), tx.stable_id("doc", F.col("source"), t).alias("stable"),
        tx.has_cjk(t).alias("cjk"), F.size(tx.alias_list(t)).cast("long").alias("n_aliases"),
    )


def _parts(spark, sf):
    return read_table(spark, sf, "part")


def alias_index(spark, sf):
    """Part names as labels; parts of small size come first."""
    return identity.alias_index(_parts(spark, sf), "p_partkey", "p_name", "p_partkey", F.col("p_size") <= 10)


def term_expansion(spark, sf):
    """Brands as terms whose labels are type names; every name asks for the labels of its brand."""
    labels = _parts(spark, sf).select(F.col("p_brand").alias("term_id"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("lang"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))
    index = identity.alias_index(labels)
    asked = labels.select(F.col("label").alias("query_id"), "label").distinct()
    return identity.expand_labels(asked, index, identity.merge_terms(labels), ["small"])


def unique_or_nothing(spark, sf):
    return identity.unique_or_nothing(_parts(spark, sf).withColumn("key", F.concat_ws("|", "p_name", "p_brand", "p_size")), "key", "p_partkey")


def link_with_fallback(spark, sf):
    """The one part of a brand and type at size 1, or for those without any, the one at size 2."""
    p = _parts(spark, sf).withColumn("key", F.concat_ws("|", "p_brand", "p_type"))
    return identity.link_with_fallback(p.where("p_size = 1"), p.where("p_size = 2"), "key", "p_partkey")


def disjunctive_match(spark, sf):
    """Lines that a part key matches as part or as supplier, counted once each."""
    lines = read_table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line"), "l_partkey", "l_suppkey")
    return identity.any_of(_parts(spark, sf), lines, "p_partkey", "line", [("p_partkey", "l_partkey"), ("p_partkey", "l_suppkey")]).groupBy("p_partkey").agg(F.count("*").alias("n_lines"))


def ambiguous_scope(spark, sf):
    return identity.ambiguous(read_table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


def exact_lookup(spark, sf):
    """Five at most, small ones first."""
    brand = _parts(spark, sf).agg(F.min("p_brand")).first()[0] or ""
    return identity.exact_records(_parts(spark, sf), {"p_brand": f" {brand.upper()} "}, ["p_partkey"], demo=F.col("p_size") > 25).select("p_partkey", "p_brand", "p_size")


def alias_components(spark, sf):
    """Customers and orders by whole keys over the whole table."""
    pairs = read_table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("b"))
    return identity.alias_groups(pairs.distinct(), Scratch(spark, "alias"))


def kg_profile(spark, sf):
    """Brands as entities with sizes and types as relations; values in order of first appearance."""
    p = _parts(spark, sf)
    one = lambda c: p.select(F.col("p_brand").alias("entity"), F.col(c).cast("string").alias("value zh"), F.upper(F.col(c).cast("string")).alias("value en"), F.col("p_partkey").alias("ord"))
    rows = kg.entities(kg.edges({"crops": one("p_type"), "parts": one("p_size")}))
    return kg.profile_text(rows, 5).select("entity", "text")


def json_props(spark, sf):
    rows = read_table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("n_values"))


def chunk_docs(spark, sf):
    """Sentence packing carries state, so there is no SQL; tests hold it against its definition."""
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.chunk_udf()("text")).alias("part", "piece")).select("doc_id", "part", F.length("piece").alias("n_chars"), F.sha2("piece", 256).alias("sha256"))


def hash_embeddings(spark, sf):
    """BLAKE2 buckets, so there is no SQL."""
    return _docs(spark, sf).select("doc_id", F.size(F.filter(hash_embed("text"), lambda x: x > 0)).alias("n_buckets"))


def expanded_queries(spark, sf):
    """Greedy expansion of passages from a small dictionary, so there is no SQL."""
    d = terms.dictionary(spark, {"crop:a": ["the", "tion"], "b": ["and", "ation", "inge"], "c": ["of the", "oft"]})
    asked = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return terms.expand_queries(asked, d).select("query_id", "query_text")


_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_ANY = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_DEDUPE = f"""g AS (SELECT sha256({_STRIP.format(t='text')}) AS h, min(doc_id) AS doc_id, list(doc_id ORDER BY doc_id) AS ids, list(source ORDER BY doc_id) AS sources
  FROM documents WHERE {_STRIP.format(t='text')} <> '' GROUP BY 1)"""
_ALIAS = "SELECT regexp_replace(lower(trim({l})), '\\s+', ' ', 'g') AS norm_label, arg_min({t}, struct_pack(p := {p}, o := {o}, t := {t})) AS term_id FROM {f} WHERE length(regexp_replace(lower(trim({l})), '\\s+', ' ', 'g')) >= 2 GROUP BY 1"

SQL = {
    "doc_profile": "SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY 1, 2",
    "doc_catalog": """WITH k AS (SELECT source, lang, count(*) AS n, sum(CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END) AS bad FROM documents d GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n_docs, string_agg(lang || '=' || n, ',' ORDER BY lang || '=' || n) AS kinds, CAST(sum(bad) AS BIGINT) AS n_flagged FROM k GROUP BY 1""",
    "dedupe_exact": f"WITH {_DEDUPE} SELECT doc_id, h AS text_sha256 FROM g",
    "exact_copies": f"WITH {_DEDUPE} SELECT unnest(ids) AS doc_id, doc_id AS first, unnest(sources) AS source FROM g",
    "full_width_tokens": f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents",
    "label_places": f"SELECT query_id, word, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) WHERE word IN ({', '.join(repr(w) for w in WORDS)}) GROUP BY 1, 2",
    "site_pairs": "SELECT DISTINCT a.n_name AS name, substr(b.n_name, 1, 3) AS crop FROM nation a, nation b WHERE contains(a.n_name, substr(b.n_name, 1, 3)) OR contains(substr(b.n_name, 1, 3), a.n_name)",
    "cumulative_daily": """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS BIGINT) AS so_far
  FROM (SELECT o_orderpriority, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2)""",
    "dedupe_provenance_filter": f"WITH {_DEDUPE} SELECT doc_id, sources[1] AS source FROM g WHERE list_contains(sources, 'src3')",
    "quality_gate": f"""SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN {_STRIP.format(t="coalesce(text, '')")} = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank,
  CAST(sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_id, CAST(count(*) - count(DISTINCT doc_id) - max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate_ids,
  CAST(sum(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_no_source FROM documents""",
    "relevance_filter": f"""WITH d AS (SELECT doc_id, lower(text) AS t, split_part(lower(text), chr(10), 1) AS q FROM documents), e AS (SELECT *, substr(t, length(q) + 1) AS a FROM d)
SELECT doc_id, CASE WHEN {_ANY('q', PRODUCTION)} THEN false WHEN {_ANY('q', HEALTH)} THEN true ELSE {_ANY('a', HEALTH)} AND NOT {_ANY('a', PRODUCTION)} END AS excluded,
  CAST(CASE WHEN {_ANY('t', CROPS)} THEN 10 + n WHEN n >= 2 AND {_ANY('t', STRONG)} THEN n ELSE 0 END AS BIGINT) AS relevance
FROM (SELECT *, {' + '.join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in TERMS)} AS n FROM e)""",
    "topic_bitmask": f"SELECT mask, count(*) AS n_docs, CAST(bit_count(mask) AS BIGINT) AS n_topics FROM (SELECT CAST({_MASK('text')} AS BIGINT) AS mask FROM documents) GROUP BY 1",
    "stratified_sample": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda k: CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT)), i)""",
    "union_sources": "SELECT 'documents' AS origin, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS BIGINT) FROM pages",
    "composed_text": f"""SELECT doc_id, sha256(trim(regexp_replace(lower(concat('fi1\u20442\u30ad\u30ed ', text)), '\\s+', ' ', 'g'))) AS text_sha256,
  CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens FROM documents""",
    "label_scan": """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS p FROM benchmark),
l AS (SELECT DISTINCT unnest(list_transform(range(1, len(p)), lambda i: regexp_extract(p[i], '[a-z0-9]+$') || ' ' || regexp_extract(p[i + 1], '^[a-z0-9]+'))) AS label FROM b),
two AS (SELECT label FROM l WHERE regexp_full_match(label, '[a-z0-9]+ [a-z0-9]+')),
f AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS label FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(p)), lambda i: regexp_extract(p[i], '[a-z0-9]+$') || ' ' || regexp_extract(p[i + 1], '^[a-z0-9]+'))) AS label FROM (SELECT doc_id, string_split(t, ' ') AS p FROM d)),
a AS (SELECT * FROM f WHERE length(label) >= 2 UNION ALL SELECT * FROM g WHERE label IN (SELECT label FROM two))
SELECT doc_id, count(*) AS n_places, count(DISTINCT label) AS n_labels, arg_max(label, lpad(CAST(length(label) AS VARCHAR), 9, '0') || label) AS longest FROM a GROUP BY doc_id""",
    "entity_scan": """WITH n AS (SELECT DISTINCT p_brand AS entity, unnest(string_split(p_name, ' ')) AS label FROM part),
k AS (SELECT DISTINCT label FROM n WHERE length(label) >= 2),
h AS (SELECT doc_id, label FROM documents, k WHERE contains(lower(text), label)),
e AS (SELECT doc_id, entity, label FROM h JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY length(label) DESC, label) = 1)
SELECT doc_id, entity, label, row_number() OVER (PARTITION BY doc_id ORDER BY length(label) DESC, entity) AS rank FROM e QUALIFY rank <= 10""",
    "dictionary_scan": f"SELECT DISTINCT doc_id, w AS word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE w IN ({', '.join(repr(w) for w in WORDS)})",
    "text_functions": f"""WITH d AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l, {_STRIP.format(t='text')} AS s FROM documents)
SELECT doc_id, CASE WHEN length(l) <= 100 THEN l ELSE substr(l, 1, 99) || '…' END AS snippet, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 59) || '…' END AS clip,
  source || '___' || lang AS path, substr(sha256(upper(source) || ':2024-01-05:' || lang), 1, 16) AS thread, 'doc:' || substr(sha256(source || chr(31) || text), 1, 16) AS stable,
  regexp_matches(text, '[一-鿿]') AS cjk, CAST(len(list_filter(list_transform(string_split_regex(text, '[;；,，、/|]'), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_aliases FROM d""",
    "alias_index": _ALIAS.format(l="p_name", t="p_partkey", p="CASE WHEN p_size <= 10 THEN 0 ELSE 1 END", o="p_partkey", f="part"),
    "term_expansion": """WITH l AS (SELECT p_brand AS term_id, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS lang, p_type AS label, p_partkey AS ord FROM part),
i AS (""" + _ALIAS.format(l="label", t="term_id", p="0", o="ord", f="l") + """)
SELECT DISTINCT q.label AS query_id, m.label FROM (SELECT DISTINCT label FROM l) q JOIN i ON i.norm_label = regexp_replace(lower(trim(q.label)), '\\s+', ' ', 'g') JOIN l m ON m.term_id = i.term_id AND m.lang = 'small'""",
    "unique_or_nothing": "SELECT concat_ws('|', p_name, p_brand, p_size) AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1",
    "link_with_fallback": """WITH p AS (SELECT p_brand || '|' || p_type AS key, p_partkey, p_size FROM part), a AS (SELECT * FROM p WHERE p_size = 1), b AS (SELECT * FROM p WHERE p_size = 2 AND key NOT IN (SELECT key FROM a))
SELECT key, min(p_partkey) AS p_partkey FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1""",
    "disjunctive_match": "SELECT p_partkey, count(*) AS n_lines FROM (SELECT DISTINCT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey UNION SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_suppkey) GROUP BY 1",
    "ambiguous_scope": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_scopes, count(DISTINCT o_orderpriority) > 1 AS refused FROM orders GROUP BY 1",
    "exact_lookup": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size > 25, p_partkey LIMIT 5",
    # an order has one customer, so a customer's group is its orders; its own name sorts first
    "alias_components": "SELECT DISTINCT 'c' || o_custkey AS name, 'c' || o_custkey AS group_id FROM orders UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders",
    "kg_profile": """WITH v AS (SELECT p_brand AS entity, 'crops' AS relation, p_type AS v, p_partkey AS ord FROM part UNION ALL SELECT p_brand, 'parts', CAST(p_size AS VARCHAR), p_partkey FROM part),
f AS (SELECT entity, relation, v, min(ord) AS o FROM v GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, relation ORDER BY o, v) AS k FROM f),
l AS (SELECT entity, relation, string_agg(v, ', ' ORDER BY o, v) AS zh, string_agg(upper(v), ', ' ORDER BY o, v) AS en FROM k WHERE k <= 5 GROUP BY 1, 2)
SELECT entity, string_agg(relation || ': ' || zh || ' / ' || en, chr(10) ORDER BY relation) AS text FROM l GROUP BY 1""",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS n_values FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in [*SQL, "chunk_docs", "hash_embeddings", "expanded_queries"]}
