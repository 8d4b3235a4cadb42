"""Queries over nested metadata, ledger tables, digests and triples, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.functions import nested
from larkfield.operators import digest, filters, triples
from larkfield.plans import cases
from larkfield.runtime import Scratch, read_table
from larkfield.sources.ledger_table import LedgerTable

DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def nested_props(spark, sf):
    """Events whose JSON properties hold one of three numbers, by type."""
    events = read_table(spark, sf, "events").withColumn("meta", nested.parsed(F.col("props")))
    return filters.allowed(events, meta={"k": [7, "13", 21.0]}).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def nested_documents(spark, sf):
    """Documents by a measurement deep in their metadata, by tags in lists, and by data sets, those of copies included."""
    meta = F.to_json(F.struct(
        F.col("lang").alias("dataset"),
        F.array(F.struct(F.when(F.col("doc_id") % 5 == 0, "xx").otherwise("yy").alias("dataset"))).alias("also_seen_in"),
        F.struct(F.struct((F.length("text") % 7).alias("value"), F.lit("mS/cm").alias("unit")).alias("EC")).alias("measurements"),
        F.array(F.array(F.upper("source")), F.array(F.lit("all"))).alias("tags"),
    ))
    docs = read_table(spark, sf, "documents").withColumn("meta", nested.parsed(meta))
    return filters.allowed(docs, meta={"measurements.EC.value": [3, 5], "dataset": ["DE", "xx"], "tags": ["src0", "src1", "src2"]}).select("doc_id", "source")


def ledger_table(spark, sf):
    """The decision log written in two batches, the first of them twice, then settled by the outcomes of odd sites."""
    log = cases._log(spark, sf).withColumn("outcome", F.when(F.col("status") == "pending", F.lit("")).otherwise(F.col("outcome")))
    table = LedgerTable(spark, Scratch(spark, "ledger").path("table"), ["event_id"], buckets=16)
    for number, rows in ((0, log.where("event_id % 3 = 0")), (0, log.where("event_id % 3 = 1")), (1, log)):
        table.append(rows, [F.col("event_id")], stream="events", batch=number)
    table.settle(cases._log(spark, sf).where("site % 2 = 1").select("event_id", "outcome"))
    return table.read().select("event_id", "status", "outcome")


def set_digests(spark, sf):
    """A digest of the documents of each language, merged from those of their sources."""
    parts = digest.states(read_table(spark, sf, "documents"), DOCUMENT, ["lang", "source"])
    return digest.digests(digest.merged(parts, ["lang"]), ["lang"])


def _thesaurus(spark, sf):
    """Parts as concepts: names preferred in English, brands and types as alternative labels, types preferred in German."""
    p = read_table(spark, sf, "part").withColumn("subject", F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    rows = F.array(*[
        F.struct(F.lit(predicate).alias("predicate"), F.col(c).alias("object"), F.lit(lang).alias("lang"))
        for predicate, c, lang in ((triples.PREFERRED, "p_name", "en"), (triples.ALTERNATIVE, "p_brand", "en"), (triples.PREFERRED, "p_type", "de"), ("skos:inScheme", "p_brand", ""))
    ])
    return p.select("subject", F.explode(rows).alias("t")).select("subject", "t.*")


def thesaurus_labels(spark, sf):
    """Preferred labels of the concepts that names, brands and one unknown word stand for."""
    p = read_table(spark, sf, "part")
    asked = p.where("p_size <= 5").select(F.col("p_name").alias("label")).unionByName(p.select(F.col("p_brand").alias("label"))).unionByName(spark.range(1).select(F.lit("no such").alias("label")))
    return triples.concept_labels(_thesaurus(spark, sf), asked.withColumn("lang", F.lit("en")), ["en", "de"])


def graph_patterns(spark, sf):
    """Names of concepts of a scheme, with their German label where it is PROMO; counted, as bindings repeat."""
    t = _thesaurus(spark, sf)
    named = triples.match(t, [("?c", "skos:inScheme", "?scheme"), ("?c", triples.PREFERRED, "?name", "en")])
    out = triples.optional(named, t.where("object = 'PROMO'"), [("?c", triples.PREFERRED, "?german", "de")])
    return out.groupBy("scheme", "name", "german").agg(F.count("*").alias("n"))


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))
_FIELD = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in DOCUMENT)

SQL = {
    "nested_props": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE json_extract_string(props, '$.k') IN ('7', '13', '21') GROUP BY 1",
    "nested_documents": "SELECT doc_id, source FROM documents WHERE length(text) % 7 IN (3, 5) AND (coalesce(lang = 'de', false) OR doc_id % 5 = 0) AND source IN ('src0', 'src1', 'src2')",
    "ledger_table": cases.SQL["settlement"],
    "set_digests": f"SELECT lang, count(*) AS n, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {_WORDS})) AS digest FROM (SELECT lang, sha256({_FIELD}) AS h FROM documents) GROUP BY lang",
    "thesaurus_labels": """WITH a AS (SELECT DISTINCT label FROM (SELECT p_name AS label FROM part WHERE p_size <= 5 UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'no such')),
c AS (SELECT DISTINCT label, p_partkey FROM a JOIN part ON label IN (p_name, p_brand, p_type)),
f AS (SELECT DISTINCT label, unnest(['en', 'de']) AS other_lang, unnest([p_name, p_type]) AS other_label FROM c JOIN part USING (p_partkey))
SELECT a.label, 'en' AS lang, other_lang, other_label FROM a LEFT JOIN f ON a.label = f.label""",
    "graph_patterns": "SELECT p_brand AS scheme, p_name AS name, CASE WHEN p_type = 'PROMO' THEN p_type END AS german, count(*) AS n FROM part GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
