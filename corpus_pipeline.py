"""A training-data pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and all but the last
return the columns of documents. ``run`` writes every stage's rows to the shared folder and reads them
again, as a production run would, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.llm import decontaminate, language, mixing, near_dedup, pii
from larkfield.runtime import Scratch, read_table

NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language. lang stays as given; where it is null it is filled in.

    What is likely follows from the labelled texts (``language.LEAST_SHARE``). Where no row has a label, nothing
    can be learned, and all documents with a letter stay.
    """
    net = language.train(docs, "doc_id", "text", "lang", ~language.held_out())
    if net is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    out = language.identify(docs, net)
    found = F.col(out.columns[-1])
    kept = out.where((found["lang"] != "und") & (found["score"] >= net.least))
    return kept.withColumn("lang", F.coalesce("lang", found["lang"])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group, equal texts of one id once; rows without an id stay."""
    groups = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    alone = docs.where("doc_id IS NULL")
    kept = docs.where("doc_id IS NOT NULL").join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(alone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    out = pii.find_pii(docs, pii.train(docs))
    clean = F.col(out.columns[-1])["redacted"]
    n_chars = {"n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": clean, **n_chars}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes anything of, with how often, and how many tokens of one more epoch."""
    return mixing.mix(docs).where("epochs > 0 OR last_tokens > 0")


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("mixture", mix_sources),
]

#: a recurrent network decides in the first stage, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
