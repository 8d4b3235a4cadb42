"""Term dictionaries: query expansion with symptom synonyms, and terms from entities and cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkfield.functions.text import label_pattern, normalize
from larkfield.operators.identity import alias_index
from larkfield.operators.scan import find_labels

# Descriptions of symptoms that stand for each other in queries.
SYMPTOMS = (
    ("water-soaked", "water soaked", "水浸状", "水渍状"),
    ("white mold", "white mould", "白色霉层", "白色霉状物"),
    ("angular spots", "angular lesions", "多角形病斑", "角斑"),
    ("dark green", "暗绿色"),
    ("chlorosis", "yellowing", "黄化"),
    ("powdery growth", "白色粉层"),
)


def dictionary(spark: SparkSession, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """(term_id, lang, label, ord) of terms with their labels in order."""
    rows = [(t, "", label, k) for t, labels in terms.items() for k, label in enumerate(labels)]
    return spark.createDataFrame(rows, "term_id string, lang string, label string, ord int")


def occurrences(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, text, key, term_id, spans): every label of a dictionary that a normalised query names, with its places.

    Automata over the whole dictionary find them in one reading of each query. A label of several terms belongs to a
    crop first, then to the least order.
    """
    index = alias_index(labels, preferred=F.startswith("term_id", F.lit("crop:"))).select(F.col("norm_label").alias("key"), "term_id")
    found = find_labels(queries.select("query_id", "text"), index, label_col="key")
    held = found.select("query_id", "text", "found", F.explode(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("key"))
    mine = F.filter("found", lambda x: x["label"] == F.col("key"))
    spans = F.transform(mine, lambda x: F.struct((x["start"] + 1).alias("s"), (x["end"] + 1).alias("e")))
    return held.join(index, "key").select("query_id", "text", "key", "term_id", spans.alias("spans"))


def _chosen(found: Column, most: int) -> Column:
    """The terms of the longest labels, each label at its places that no longer one covers; a term counts once."""
    State = "struct<used:array<string>,taken:array<struct<s:int,e:int>>>"

    def step(held: Column, label: Column) -> Column:
        free = F.filter(label["spans"], lambda x: ~F.exists(held["taken"], lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
        new = (F.size(free) > 0) & ~F.array_contains(held["used"], label["term_id"]) & (F.size(held["used"]) < most)
        return F.when(new, F.struct(F.concat(held["used"], F.array(label["term_id"])).alias("used"), F.concat(held["taken"], free).alias("taken")).cast(State)).otherwise(held)

    return F.aggregate(found, F.struct(F.array().alias("used"), F.array().alias("taken")).cast(State), step, lambda held: held["used"])


def expand_queries(queries: DataFrame, labels: DataFrame, text_col: str = "query_text", max_terms: int = 4) -> DataFrame:
    """Every query followed by what it may also be called, ``3 * max_terms`` labels at most, each once.

    First come symptoms that stand for one that the query names, then the labels of the terms that it names, of at
    most ``max_terms`` terms, the longest names first; what the query holds already isn't added. ``labels`` is a dictionary
    (term_id, lang, label, ord). A null query is empty; rows that repeat a query_id count as one query.
    """
    asked = queries.select("query_id", normalize(F.col(text_col)).alias("text")).dropDuplicates(["query_id"])
    order = F.struct((-F.length("key")).alias("n"), "key", "term_id", "spans")
    terms = occurrences(asked, labels).groupBy("query_id", "text").agg(F.array_sort(F.collect_list(order)).alias("found"))  # a query's own words
    terms = terms.select("query_id", "text", F.posexplode(_chosen(F.col("found"), max_terms)).alias("k", "term_id"))
    more = terms.join(labels.select("term_id", "ord", "label"), "term_id").where(~F.contains("text", normalize(F.col("label"))) & (F.trim("label") != ""))
    more = more.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ord", "label"))), lambda x: x["label"]).alias("more"))
    text = F.col("text")
    groups = [
        F.when(F.rlike(text, F.lit("|".join(map(label_pattern, group)))), F.filter(F.array(*map(F.lit, group)), lambda x: ~F.contains(text, x))).otherwise(F.array().cast("array<string>"))
        for group in SYMPTOMS
    ]
    added = asked.join(more, "query_id", "left").select("query_id", F.slice(F.array_distinct(F.concat(*groups, F.coalesce("more", F.array().cast("array<string>")))), 1, 3 * max_terms).alias("lf_added"))
    own = F.coalesce(F.col(text_col), F.lit(""))
    out = queries.join(added, "query_id", "left")
    out = out.withColumn(text_col, F.when(F.size("lf_added") > 0, F.concat_ws(" ", own, F.array_join("lf_added", " "))).otherwise(own))
    return out.select(*queries.columns)


def terms_from_entities(entities: DataFrame) -> DataFrame:
    """(term_id, lang, label, ord) from (name, scientific, english array, crops array, crops_en array).

    Crops are paired by place only where both lists are equally long; otherwise each name stands alone.
    """
    own = entities.select(
        F.concat(F.lit("entity:"), "name").alias("term_id"),
        F.explode(F.concat(
            F.array(F.struct(F.lit("zh").alias("lang"), F.col("name").alias("label"))),
            F.transform("english", lambda x: F.struct(F.lit("en").alias("lang"), x.alias("label"))),
            F.array(F.struct(F.lit("la").alias("lang"), F.col("scientific").alias("label"))),
        )).alias("l"),
    )
    paired = F.transform(F.arrays_zip("crops", "crops_en"), lambda x: F.struct(x["crops"].alias("key"), F.array(
        F.struct(F.lit("zh").alias("lang"), x["crops"].alias("label")), F.struct(F.lit("en").alias("lang"), x["crops_en"].alias("label"))).alias("labels")))
    alone = lambda c, lang: F.transform(c, lambda x: F.struct(x.alias("key"), F.array(F.struct(F.lit(lang).alias("lang"), x.alias("label"))).alias("labels")))
    crops = F.when(F.size("crops") == F.size("crops_en"), paired).otherwise(F.concat(alone("crops", "zh"), alone("crops_en", "en")))
    crop = entities.select(F.explode(crops).alias("c")).select(F.concat(F.lit("crop:"), "c.key").alias("term_id"), F.explode("c.labels").alias("l"))
    out = own.unionByName(crop).select("term_id", "l.lang", "l.label").where("label is not null and label <> ''")
    return out.distinct().withColumn("ord", F.lit(0))


def terms_from_cards(cards: DataFrame) -> DataFrame:
    """(term_id, lang, label, ord) from cards (disease_id, disease, aliases array, scientific, crop); a crop is a term of its own."""
    rows = F.concat(
        F.array(F.struct(F.concat(F.lit("card:"), "disease_id").alias("term_id"), F.lit("en").alias("lang"), F.col("disease").alias("label"))),
        F.transform("aliases", lambda x: F.struct(F.concat(F.lit("card:"), "disease_id").alias("term_id"), F.lit("en").alias("lang"), x.alias("label"))),
        F.array(
            F.struct(F.concat(F.lit("card:"), "disease_id").alias("term_id"), F.lit("la").alias("lang"), F.col("scientific").alias("label")),
            F.struct(F.concat(F.lit("crop:"), "crop").alias("term_id"), F.lit("en").alias("lang"), F.col("crop").alias("label")),
        ),
    )
    out = cards.select(F.posexplode(rows).alias("ord", "t")).select("t.term_id", "t.lang", "t.label", "ord")
    return out.where("label is not null and label <> ''")


def enrich(labels: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the labels of a cached thesaurus (lang, label, other_lang, other_label) to terms that exist; a null other_label is a cached miss."""
    hit = labels.join(cache.where("other_label is not null"), ["lang", "label"]).select("term_id", F.col("other_lang").alias("lang"), F.col("other_label").alias("label"), (F.col("ord") + 1).alias("ord"))
    return labels.unionByName(hit.select(*labels.columns)).groupBy("term_id", "lang", "label").agg(F.min("ord").alias("ord"))


def thesaurus_labels(preferred: DataFrame, alternative: DataFrame) -> DataFrame:
    """(term_id, lang, label): the preferred and alternative labels of a thesaurus, each once."""
    columns = ("term_id", "lang", "label")
    return preferred.select(*columns).unionByName(alternative.select(*columns)).distinct()
