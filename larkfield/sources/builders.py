"""Source builders: each turns raw rows into documents (doc_id, source, kind, title, text, lang, parent_id, meta map)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from larkfield.functions.text import chunk_udf, stable_id, text_of
from larkfield.operators.corpus import dedupe_exact, excluded, relevance

COLUMNS = ("doc_id", "source", "kind", "title", "text", "lang", "parent_id", "meta")


def document(doc_id, source: str, kind, title, text, lang, parent=None, meta: Column | None = None) -> list[Column]:
    values = [doc_id, F.lit(source), kind, title, text, lang, F.lit("") if parent is None else parent, F.create_map().cast("map<string,string>") if meta is None else meta]
    return [v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]


def seed(raw: DataFrame) -> DataFrame:
    """Bundled rows (id, kind, title, lang, text, parent, meta map): always marked as demonstration."""
    meta = F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("flags", "demo")), F.create_map(F.lit("demo"), F.lit("true"), F.lit("flags"), F.lit("demo")))
    return raw.select(*document(F.col("id"), "seed", F.col("kind"), F.col("title"), F.col("text"), F.coalesce("lang", F.lit("zh")), F.coalesce("parent", F.lit("")), meta))


CURATED_FIELDS = ("source_ref", "citation", "publisher", "retrieved_at", "applicability", "evidence_status")


def curated_errors(meta: Column) -> Column:
    """What a curated row lacks: each provenance field, an https reference and an ISO date."""
    checks = [F.when(text_of(F.element_at(meta, F.lit(k))) == "", f"missing {k}") for k in CURATED_FIELDS]
    checks.append(F.when(~F.startswith(F.coalesce(F.element_at(meta, F.lit("source_ref")), F.lit("")), F.lit("https://")), "source_ref is no https url"))
    day = F.element_at(meta, F.lit("retrieved_at"))
    checks.append(F.when(F.coalesce(F.date_format(F.try_to_date(day, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(day), "yyyy-MM-dd") != day, F.lit(True)), "retrieved_at is no ISO date"))
    return F.array_compact(F.array(*checks))


def curated(raw: DataFrame) -> DataFrame:
    """Rows with whole provenance; any other fails the build."""
    bad = raw.withColumn("errors", curated_errors(F.col("meta"))).where(F.size("errors") > 0).select("id", "errors").take(5)
    if bad:
        raise ValueError(f"curated rows without provenance: {[(r.id, r.errors) for r in bad]}")
    return raw.select(*document(F.col("id"), "curated", F.col("kind"), F.col("title"), F.col("text"), F.col("lang"), None, F.col("meta")))


_GENERIC = ("all", "any", "unknown", "default", "none", "通用", "全部", "未知")
LOCAL_KEYS = {"soil_record": ("site_id", "site_ids"), "equipment_manual": ("device_id", "device_ids"), "treatment": ("disease_id", "parent_id"), "management": ("disease_id", "parent_id")}


def local_errors(kind: Column, text: Column, meta: Column) -> Column:
    """What a local row lacks: text, a reference, and for some kinds an identifier that is neither generic nor a wildcard."""
    value = lambda k: text_of(F.element_at(meta, F.lit(k)))
    out = [F.when(text_of(text) == "", "no text"), F.when(value("source_ref") == "", "no source_ref")]
    for name, keys in LOCAL_KEYS.items():
        given = [value(k) for k in keys]
        fine = F.lit(False)
        for g in given:
            fine = fine | ((g != "") & ~F.lower(g).isin(*_GENERIC) & ~F.rlike(g, F.lit(r"[*?\[\]]")))
        out.append(F.when((kind == name) & ~fine, f"{name} without identifier"))
    return F.array_compact(F.array(*out))


def local(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Every row is validated, also those beyond the limit."""
    bad = raw.withColumn("errors", local_errors(F.col("kind"), F.col("text"), F.col("meta"))).where(F.size("errors") > 0).select("title", "errors").take(5)
    if bad:
        raise ValueError(f"local rows were refused: {[(r.title, r.errors) for r in bad]}")
    out = raw.select(*document(F.coalesce("id", stable_id("local", F.col("kind"), F.col("title"), F.col("text"))), "local", F.col("kind"), F.col("title"), F.col("text"), F.lit("zh"), None, F.col("meta")))
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def entity_profiles(profiles: DataFrame, max_chars: int = 600, overlap: int = 60) -> DataFrame:
    """A document for each chunk of an entity's profile (entity, text)."""
    part = profiles.select("entity", F.posexplode(chunk_udf(max_chars, overlap)("text")).alias("part", "piece"))
    return part.select(*document(F.concat_ws("#", F.concat(F.lit("kg:"), "entity"), "part"), "kg", F.lit("kg_entity"), F.col("entity"), F.col("piece"), F.lit("zh"), F.concat(F.lit("kg:"), "entity")))


def card_documents(cards: DataFrame) -> DataFrame:
    """Up to six kinds of documents of each disease card; one symptom document for each part of the plant.

    cards: (disease_id, disease, crop, scientific, aliases array, symptoms map<string,array<string>>, diagnosis,
    management, environment, severity, lookalikes array). Blank bodies make no document.
    """
    join = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), "; ")
    title = F.concat_ws(" · ", "crop", "disease")
    body = F.concat_ws("\n", F.concat(F.lit("disease: "), "disease"), F.concat(F.lit("host: "), "crop"), F.concat(F.lit("pathogen: "), "scientific"), F.concat(F.lit("also called: "), join(F.col("aliases"))))
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("part"), text.alias("text"))
    rows = F.concat(
        F.array(one("disease_card", body), one("diagnosis", F.col("diagnosis")), one("management", F.col("management")), one("environment", F.col("environment")), one("severity", F.col("severity")), one("lookalike", join(F.col("lookalikes")))),
        F.transform(F.map_entries("symptoms"), lambda e: F.struct(F.lit("symptom").alias("kind"), e["key"].alias("part"), join(e["value"]).alias("text"))),
    )
    out = cards.select("disease_id", "crop", "disease", title.alias("title"), F.explode(rows).alias("r")).where(text_of(F.col("r.text")) != "")
    doc_id = F.concat_ws(":", F.lit("card"), "disease_id", "r.kind", F.nullif(F.col("r.part"), F.lit("")))
    meta = F.create_map(F.lit("disease_id"), "disease_id", F.lit("crop"), "crop", F.lit("disease"), "disease")
    return out.select(*document(doc_id, "cards", F.col("r.kind"), F.col("title"), F.col("r.text"), F.lit("en"), F.concat(F.lit("card:"), "disease_id"), meta))


def qa_english(parts: dict[str, DataFrame], production, health, least: int = 25) -> DataFrame:
    """Question-answer rows of several sets (id, question, answer, worked_solution): topical, long enough, once each."""
    out = None
    for name, raw in parts.items():
        question = text_of(F.coalesce(*[F.col(c) for c in ("question", "prompt") if c in raw.columns]))
        answer = text_of(F.coalesce(*[F.col(c) for c in ("answer", "answers", "response") if c in raw.columns]))
        worked = text_of(F.col("worked_solution")) if "worked_solution" in raw.columns else F.lit("")
        rows = raw.select(F.coalesce(F.col("id").cast("string"), stable_id("row", question, answer)).alias("row"), question.alias("q"), answer.alias("a"), worked.alias("w"), F.lit(name).alias("dataset"))
        rows = rows.where((F.col("q") != "") & (F.greatest(F.length("a"), F.length("w")) >= least) & ~excluded(F.lower("q"), F.lower("a"), production, health))
        out = rows if out is None else out.unionByName(rows)
    docs = out.select("dataset", F.concat_ws(":", F.lit("qa_en"), "dataset", "row").alias("doc_id"), F.col("q").alias("title"), F.concat_ws("\n", "q", "a", F.nullif(F.col("w"), F.lit(""))).alias("text"))
    docs = dedupe_exact(docs, provenance=("dataset",), with_copies=True)
    meta = F.create_map(F.lit("dataset"), "dataset", F.lit("also_seen_in"), F.array_join(F.array_distinct(F.transform("also_seen_in", lambda x: x["dataset"])), ","))
    return docs.select(*document(F.col("doc_id"), "qa_en", F.lit("qa_pair"), F.col("title"), F.col("text"), F.lit("en"), None, meta))


def qa_chinese(raw: DataFrame, crops, terms, strong, order: str = "ord", accept: int = 6000, least: int = 40) -> DataFrame:
    """Relevant rows (ord, prompt, response) in scan order, the first ``accept`` of them."""
    text = F.concat_ws("\n", text_of(F.col("prompt")), text_of(F.col("response")))
    rows = raw.withColumn("text", text).where((F.length(text_of(F.col("response"))) >= least) & (relevance(F.col("text"), crops, terms, strong) > 0))
    rows = dedupe_exact(rows.withColumn("doc_id", F.concat(F.lit("qa_zh:"), F.lpad(F.col(order).cast("string"), 12, "0"))), provenance=()).orderBy(order).limit(accept)
    return rows.select(*document(F.col("doc_id"), "qa_zh", F.lit("qa_pair"), text_of(F.col("prompt")), F.col("text"), F.lit("zh")))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "seed": seed, "curated": curated, "kg": entity_profiles, "cards": card_documents, "qa_en": qa_english, "qa_zh": qa_chinese, "local": local,
}


def resolve(names: list[str]) -> list[str]:
    """Known names in order, each once."""
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise KeyError(f"no such sources: {unknown}; known are {sorted(REGISTRY)}")
    return list(dict.fromkeys(names))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
