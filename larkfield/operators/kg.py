"""Entity attributes as an edge table, and matching of observed symptoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larkfield.operators.identity import weighted_best
from larkfield.operators.lexical import bm25

FIELDS = ("crops", "symptoms", "conditions", "parts", "regions", "temps")


def value_columns(columns: list[str]) -> list[str]:
    """The value columns of a relation table, by position: what is left without number, entity, name and relation columns."""
    skip = ("number", "entity", "scientific", "binomial", "relation", "编号", "实体", "关系")
    return [c for c in columns if not any(s in c.strip().lower() for s in skip)][:2]


def edges(tables: dict[str, DataFrame], entity_col: str = "entity", order_col: str = "ord") -> DataFrame:
    """(entity, relation, value_zh, value_en, ord) of all relation tables; blank entities vanish."""
    out = None
    for relation, table in tables.items():
        zh, *en = value_columns([c for c in table.columns if c != order_col])
        trimmed = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
        part = table.select(
            F.trim(entity_col).alias("entity"), F.lit(relation).alias("relation"), trimmed(zh).alias("value_zh"),
            (trimmed(en[0]) if en else F.lit(None).cast("string")).alias("value_en"), F.col(order_col).alias("ord"),
        ).where("entity <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def entities(edge: DataFrame) -> DataFrame:
    """(entity, relation, values_zh, values_en): distinct values in order of first appearance."""
    parts = []
    for column in ("value_zh", "value_en"):
        first = edge.where(F.col(column).isNotNull()).groupBy("entity", "relation", column).agg(F.min("ord").alias("o"))
        packed = first.groupBy("entity", "relation").agg(F.array_sort(F.collect_list(F.struct("o", column))).alias("v"))
        parts.append(packed.select("entity", "relation", F.col("v").getField(column).alias(column.replace("value", "values"))))
    return parts[0].join(parts[1], ["entity", "relation"], "full_outer")


def match_symptoms(
    queries: DataFrame, symptoms: DataFrame, query_id: str = "query_id", query_text: str = "query_text", top_k: int = 5, floor: float = 0.05
) -> DataFrame:
    """(query_id, entity, score, rank): BM25 over each symptom as a small document, relative to the query's best.

    Matches under ``floor`` are dropped; an entity's three best count 0.7, 0.2 and 0.1. ``symptoms`` has
    (entity, symptom_id, symptom). Ties go by the entity's name.
    """
    scores = bm25(queries, symptoms, query_id=query_id, query_text=query_text, id_col="symptom_id", text_col="symptom", gate=False)
    peak = F.max("bm25_score").over(Window.partitionBy("query_id"))
    part = scores.withColumn("part", F.round(F.col("bm25_score") / peak, 6)).where(F.col("part") >= floor)
    owned = part.join(symptoms.select(F.col("symptom_id").alias("doc_id"), "entity"), "doc_id")
    best = weighted_best(owned, ["query_id", "entity"], "part")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def related_crops(names: DataFrame, crops: DataFrame) -> DataFrame:
    """(name, crop) where either holds the other, by equi-joins on what a name holds: all of its parts."""
    a, b = names.select("name").where("name <> ''").distinct(), crops.select("crop").where("crop <> ''").distinct()

    def parts(c: str):
        at = F.sequence(F.lit(1), F.length(c))
        return F.explode(F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.col(c).substr(i, n))))))

    within = a.select("name", parts("name").alias("crop")).join(b, "crop").select("name", "crop")
    return within.unionByName(b.select("crop", parts("crop").alias("name")).join(a, "name").select("name", "crop")).distinct()


def profile_text(rows: DataFrame, most: int = 12) -> DataFrame:
    """(entity, text): one line for each relation, with at most ``most`` values in each language."""
    cut = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most), ", ")
    line = F.concat_ws(" / ", F.nullif(cut(F.col("values_zh")), F.lit("")), F.nullif(cut(F.col("values_en")), F.lit("")))
    lines = rows.select("entity", F.struct("relation", F.concat_ws(": ", "relation", line).alias("line")).alias("l"))
    return lines.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
