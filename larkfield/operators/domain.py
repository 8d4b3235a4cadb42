"""Composite questions over a knowledge base: card links, treatments, agronomy and diagnosis.

Documents are a DataFrame (doc_id, kind, title, text, source, ...) with the arrays crops and names and
the strings parent_id and disease_id where a kind has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.functions.text import label_pattern, normalize, snippet
from larkfield.operators.corpus import mask
from larkfield.operators.fusion import rrf
from larkfield.operators.identity import alias_groups, ambiguous, any_of, first_rank, link_with_fallback
from larkfield.operators.lexical import bm25, ranked
from larkfield.operators.scan import find_labels
from larkfield.runtime import Scratch

# Names of rice that count as one crop, whatever the dictionary says.
RICE = ("水稻", "rice", "paddy", "sali paddy", "kharif paddy")
# Phrase groups of management topics, growth stages and actions.
TOPICS = (
    ("浇水", "灌溉", "灌水", "滴灌", "水分", "水肥", "watering", "irrigation", "irrigate"),
    ("施肥", "追肥", "肥料", "养分", "水肥", "fertilizer", "fertilization", "fertilisation", "fertility"),
    ("湿度", "降湿", "除湿", "叶面潮湿", "露水", "结露", "humidity", "condensation", "leaf wetness"),
    ("连作", "重茬", "连着种", "连续种植", "土传", "continuous cropping", "soilborne", "crop rotation"),
    ("盐分", "盐渍", "盐碱", "根区ec", "salinity", "salinization", "salt accumulation"),
    ("通风", "ventilation", "air circulation"),
)
STAGES = (
    ("定植", "刚栽", "移栽", "缓苗", "transplant", "transplanting"),
    ("结果", "坐果", "膨果", "膨大", "fruiting", "fruit set", "fruit development"),
)
MANAGEMENT = (
    "管理", "防治", "打药", "用药", "减缓", "减少", "改善", "调整", "注意事项", "栽培", "措施",
    "control", "treat", "treatment", "manage", "management", "reduce", "improve", "cultivation",
)
ACTIONS = MANAGEMENT + (
    "采用", "避免", "保持", "降低", "控制", "选用", "清除", "轮作", "嫁接", "增施", "排湿", "灌水",
    "浇水", "追肥", "施肥", "通风", "防止", "应当", "应及时", "建议", "需要", "注意",
    "use", "avoid", "maintain", "apply", "irrigate", "fertilize", "remove", "rotate", "prevent",
)
# Fixed value: a dose, that is a number with a unit.
RATE = r"(?i)\d[\d.,]*\s*(?:(?:kg|mg|g|ml|l|ppm)(?![a-z])|公斤|千克|毫克|克|毫升|升)"


def _phrase(word: str) -> str:
    return label_pattern(word, underscore=True)


def is_demo(source: Column, demo: Column, status: Column) -> Column:
    return (source == "seed") | F.coalesce(demo, F.lit(False)) | (F.coalesce(status, F.lit("")) == "demo")


def crops_match(own: Column, wanted: Column) -> Column:
    """No crop wanted matches all; otherwise names have to overlap as whole names, both sides expanded by their groups."""
    return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(own, wanted), F.lit(False))


def crop_groups(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, group_id): normalised names of crops, those of one crop under one id.

    Only terms of crops count (``crop:`` alone or after a prefix) of a dictionary (term_id, label). Terms that share
    a name are one crop, and so are the names of rice.
    """
    terms = labels.where(F.startswith("term_id", F.lit("crop:")) | F.contains("term_id", F.lit(":crop:"))).select("term_id", normalize(F.col("label")).alias("b")).where("b <> ''")
    pairs = terms.join(terms.groupBy("term_id").agg(F.min("b").alias("a")), "term_id").select("a", "b")
    rice = labels.sparkSession.createDataFrame([(RICE[0], name) for name in RICE], "a string, b string")
    return alias_groups(pairs.unionByName(rice), scratch)


def crop_as_group(rows: DataFrame, col: str, groups: DataFrame | None) -> DataFrame:
    """``rows`` with the id of the crop's group in place of its name, or with its normalised name where it has none."""
    if groups is None:
        return rows
    named = rows.withColumn(col, F.when(F.col(col).isNotNull(), normalize(F.col(col))))
    known = groups.select(F.col("name").alias("lf_name"), F.col("group_id").alias("lf_group"))
    return named.join(known, F.col(col) == F.col("lf_name"), "left").withColumn(col, F.coalesce("lf_group", col)).drop("lf_name", "lf_group")


def crops_as_groups(rows: DataFrame, key: str, col: str, groups: DataFrame | None) -> DataFrame:
    """The same for an array of crops; ``key`` tells the rows apart. Null arrays become empty, null names vanish."""
    if groups is None:
        return rows
    held = crop_as_group(rows.select(key, F.explode(col).alias("lf_crop")).where("lf_crop is not null"), "lf_crop", groups)
    held = held.groupBy(key).agg(F.collect_set("lf_crop").alias("lf_crops"))  # the crops of one row
    out = rows.join(held, key, "left").withColumn(col, F.coalesce("lf_crops", F.array().cast("array<string>")))
    return out.select(*rows.columns)


def management_features(docs: DataFrame, text_col: str = "text", title_col: str = "title") -> DataFrame:
    """Adds topics, stages, action, title_topics and rate: what a text is about, as bit masks and flags."""
    body, title = normalize(F.col(text_col)), normalize(F.col(title_col))
    return docs.withColumns({
        "topics": mask(body, TOPICS, _phrase), "stages": mask(body, STAGES, _phrase), "action": mask(body, [ACTIONS], _phrase) > 0,
        "title_topics": mask(title, TOPICS, _phrase), "rate": F.rlike(body, F.lit(RATE)),
    })


def _without(text: Column, names: Column) -> Column:
    """``text`` with each of the names, as a whole, replaced by a blank; longer names first."""
    ordered = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), normalize(n).alias("n"))))
    cut = lambda t, x: F.when(x["n"] == "", t).otherwise(F.regexp_replace(t, F.concat(F.lit("(?<![a-z0-9_])\\Q"), x["n"], F.lit("\\E(?![a-z0-9_])")), F.lit(" ")))
    return F.aggregate(ordered, text, cut)


def asked_features(questions: DataFrame) -> DataFrame:
    """Adds to questions (query_id, query_text, crops): q_topics, q_stages, q_manage, and search, the words to look for.

    Crops are checked by the candidates, so their names go from the words; the words of each topic asked for are added.
    """
    text = normalize(F.col("query_text"))
    q = questions.withColumns({"q_topics": mask(text, TOPICS, _phrase), "q_stages": mask(text, STAGES, _phrase), "q_manage": mask(text, [MANAGEMENT], _phrase) > 0})
    topics = [F.when(F.col("q_topics").bitwiseAND(F.lit(1 << k)) > 0, " ".join(group)) for k, group in enumerate(TOPICS)]
    q = q.withColumn("q_manage", F.col("q_manage") | (F.col("q_topics") > 0) | (F.col("q_stages") > 0))
    return q.withColumn("search", F.concat_ws(" ", _without(text, F.coalesce("crops", F.array().cast("array<string>"))), *topics))


def prefilter(pairs: DataFrame) -> DataFrame:
    """Of pairs of asked and document features those that may answer, with crop_scope and matched (the topics in common).

    A document holds all stages asked for and a topic at least, speaks of action where management is asked for, and
    matches the crop or names none; one that names none and gives a dose is rejected.
    """
    scope = F.when(F.size("crops") == 0, "general_agronomy").when(F.size("q_crops") == 0, "unspecified").when(crops_match(F.col("crops"), F.col("q_crops")), "crop_matched")
    rows = pairs.withColumns({"crop_scope": scope, "matched": F.bit_count(F.col("topics").bitwiseAND(F.col("q_topics")))})
    rows = rows.where(F.col("crop_scope").isNotNull() & (F.col("stages").bitwiseAND(F.col("q_stages")) == F.col("q_stages")))
    rows = rows.where(((F.col("q_topics") == 0) | (F.col("matched") > 0)) & (~F.col("q_manage") | F.col("action")))
    return rows.where(~((F.col("crop_scope") == "general_agronomy") & F.col("rate")))


def named_diseases(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, disease_id, crop): cards of a question's crops whose name the question holds, with or without the crop's name.

    ``questions`` has query_id, query_text and crops; ``cards`` has disease_id, names and crops. Automata over the cards'
    names find those that a question holds, and the two meet by name and crop.
    """
    c = cards.select("disease_id", F.explode("crops").alias("crop"), "names").select("disease_id", "crop", F.explode("names").alias("name"))
    name = normalize(F.col("name"))
    c = c.select("disease_id", "crop", F.explode(F.array(name, F.trim(_without(name, F.array("crop"))))).alias("label")).where("length(label) >= 2").distinct()
    q = find_labels(questions.select("query_id", "crops", F.col("query_text").alias("text")), c)
    q = q.select("query_id", "crops", F.explode(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("label")).select("query_id", "label", F.explode("crops").alias("crop"))
    return q.join(c, ["label", "crop"]).select("query_id", "disease_id", "crop").distinct()


def agronomy(
    questions: DataFrame, docs: DataFrame, top_k: int = 5, kinds: tuple[str, ...] = ("qa_pair", "agronomy", "environment"), cards: DataFrame | None = None, plans: DataFrame | None = None
) -> DataFrame:
    """(query_id, doc_id, crop_scope, matched, rank, snippet) for questions (query_id, query_text, crops array).

    A question of management that names a disease of its crop is answered by that disease's plans alone (``cards`` and
    ``plans``, see ``treatments``), if there are any. For all others the candidates are filtered first (``prefilter``;
    entities count too where no management is asked for) and only then ranked by BM25 and cut, so a document that
    fits is never crowded out by ones that don't; then by topics, title topics, score and id. Statistics are
    those of all documents.
    """
    q = asked_features(questions).withColumnRenamed("crops", "q_crops").withColumn("q_crops", F.coalesce("q_crops", F.array().cast("array<string>")))
    d = management_features(docs.where(F.col("kind").isin(*kinds, "kg_entity"))).withColumn("crops", F.coalesce("crops", F.array().cast("array<string>")))
    features = d.select("doc_id", "kind", "crops", "topics", "stages", "action", "title_topics", "rate")
    scores = bm25(q.select("query_id", F.col("search").alias("query_text")), docs, d)
    rows = prefilter(scores.join(q.drop("query_text", "search"), "query_id").join(features, "doc_id")).where((F.col("kind") != "kg_entity") | ~F.col("q_manage"))
    rows = ranked(rows, "bm25_score", most=max(5 * top_k, 20), name="hit").withColumn("score", rrf(F.col("hit")))
    order = F.struct("matched", F.bit_count(F.col("title_topics").bitwiseAND(F.col("q_topics"))).alias("t"), "score")
    out = ranked(rows, order, most=top_k).select("query_id", "doc_id", "crop_scope", "matched", "rank")
    if cards is not None and plans is not None:
        asked = named_diseases(q.where("q_manage").select("query_id", "query_text", F.col("q_crops").alias("crops")), cards)
        none = F.lit(None).cast("string")
        answers = treatments(asked.select("query_id", none.alias("parent_id"), "disease_id", F.array(none).alias("names"), "crop"), plans).where(~F.col("refused"))
        first = answers.select("query_id", "doc_id", F.lit("crop_matched").alias("crop_scope"), F.lit(None).cast("int").alias("matched")).distinct()
        first = ranked(first, F.lit(0), most=top_k)
        out = first.unionByName(out.join(first.select("query_id").distinct(), "query_id", "left_anti").select(*first.columns))
    return out.join(docs.select("doc_id", snippet(F.col("text"), 700).alias("snippet")), "doc_id").select("query_id", "doc_id", "crop_scope", "matched", "rank", "snippet")


def link_cards(entities: DataFrame, cards: DataFrame) -> DataFrame:
    """(entity, disease_id): the one card that an entity's aliases name for its crops, else its scientific name; else nothing.

    ``entities`` has entity, aliases, scientific and crops; ``cards`` has disease_id, aliases, scientific and crops.
    """
    e, c = entities, cards.select("disease_id", F.col("aliases").alias("c_aliases"), F.col("scientific").alias("c_sci"), F.col("crops").alias("c_crops"))
    scope = F.arrays_overlap("crops", "c_crops")
    by_alias = e.select("entity", "crops", F.explode("aliases").alias("k")).join(c.select("disease_id", "c_crops", F.explode("c_aliases").alias("k")), "k").where(scope)
    by_name = e.select("entity", "crops", F.col("scientific").alias("k")).where("k <> ''").join(c.select("disease_id", "c_crops", F.col("c_sci").alias("k")), "k").where(scope)
    return link_with_fallback(by_alias.select("entity", "disease_id"), by_name.select("entity", "disease_id"), "entity", "disease_id")


def treatments(asked: DataFrame, plans: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, refused) for asked (query_id, parent_id, disease_id, names array, crop) over management plans.

    A plan matches by parent, disease or name, has to declare a host, and has to share the asked crop. Without
    a crop, plans of several hosts are refused as a whole. With ``groups`` (``crop_groups``) names of one crop are one host.
    """
    asked, plans = crop_as_group(asked, "crop", groups), crop_as_group(plans, "host", groups)
    named = asked.withColumn("name", F.explode_outer("names"))
    p = plans.where(F.col("kind").isin("management", "treatment") & F.col("host").isNotNull()).withColumn("name", F.explode_outer("names"))
    found = any_of(named, p.select("doc_id", "parent_id", "disease_id", "name"), "query_id", "doc_id", [("parent_id", "parent_id"), ("disease_id", "disease_id"), ("name", "name")])
    rows = found.join(asked.select("query_id", "crop").distinct(), "query_id").join(plans.select("doc_id", "host"), "doc_id").where("crop is null or crop = host")
    refused = ambiguous(rows.where("crop is null"), "query_id", "host").select("query_id", "refused")
    return rows.join(refused, "query_id", "left").select("query_id", "doc_id", F.coalesce("refused", F.lit(False)).alias("refused"))


def diagnose(graph: DataFrame, hits: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, identity, score, best, rank): fuses the graph's matches (query_id, identity, rank) with text hits (query_id, identity, rank).

    Each route votes once for an identity, by its first appearance.
    """
    a = first_rank(graph, "query_id", "identity", "rank").withColumnRenamed("rank", "a")
    b = first_rank(hits, "query_id", "identity", "rank").withColumnRenamed("rank", "b")
    both = a.join(b, ["query_id", "identity"], "full_outer").withColumn("score", rrf(F.col("a"), F.col("b"))).withColumn("best", F.least("a", "b"))
    order = F.struct("score", (-F.col("best")).alias("near"))
    return ranked(both, order, tie="identity", most=top_k).drop("a", "b")


def anchor_cards(asked: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, doc_id): the card that asked (query_id, disease_id, name) names by disease, id or alias, if all that match share one host.

    ``cards`` has doc_id, disease_id, names, host and demo. Of several, one that is no demonstration, then the least id.
    """
    c = cards.withColumn("name", F.explode_outer("names"))
    found = any_of(asked, c.select("doc_id", "disease_id", "name"), "query_id", "doc_id", [("disease_id", "disease_id"), ("name", "name"), ("disease_id", "doc_id")])
    rows = found.join(cards.select("doc_id", "host", "demo"), "doc_id")
    best = rows.groupBy("query_id").agg(F.count_distinct("host").alias("hosts"), F.min(F.struct(F.coalesce("demo", F.lit(False)).alias("demo"), "doc_id")).alias("best"))
    return best.where("hosts = 1").select("query_id", F.col("best.doc_id").alias("doc_id"))


def document_cards(docs: DataFrame, cards: DataFrame, anchors: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, disease_id): a document's card by its own id, else by its parent's anchor, else by its entity's link.

    ``docs`` has doc_id, disease_id, parent_id and entity; ``anchors`` (parent_id, disease_id) and ``links`` (entity, disease_id)
    have one row a key.
    """
    known = cards.select(F.col("disease_id").alias("own")).distinct()
    rows = docs.join(known, F.col("disease_id") == F.col("own"), "left")
    rows = rows.join(anchors.select("parent_id", F.col("disease_id").alias("by_anchor")), "parent_id", "left")
    rows = rows.join(links.select("entity", F.col("disease_id").alias("by_link")), "entity", "left")
    return rows.select("doc_id", F.coalesce("own", "by_anchor", "by_link").alias("disease_id")).where("disease_id is not null")


def scenario_checks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(scenario, action_ok, disposition_ok, missing, passed): what a coordinator decided against what was expected of it.

    ``results`` has scenario, action, disposition and notes; ``expected`` has scenario, actions, dispositions and keywords (arrays).
    """
    rows = expected.join(results, "scenario", "left")
    missing = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: ~F.contains(F.coalesce("notes", F.lit("")), k))
    ok = lambda c, allowed: F.coalesce(F.array_contains(allowed, F.col(c)), F.lit(False))
    out = rows.select("scenario", ok("action", "actions").alias("action_ok"), ok("disposition", "dispositions").alias("disposition_ok"), missing.alias("missing"))
    return out.withColumn("passed", F.col("action_ok") & F.col("disposition_ok") & (F.size("missing") == 0))
