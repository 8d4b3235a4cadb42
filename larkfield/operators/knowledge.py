"""A knowledge base over one published version: search, catalog, exact records and provenance in one place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from larkfield.functions.text import chunk_udf, query_terms, snippet
from larkfield.operators import corpus, domain, filters, fusion, identity, kg
from larkfield.operators.terms import expand_queries

#: kinds that need a more specific question before anything is done with them
FOLLOW_UP = {
    "management": "treatments", "treatment": "treatments", "disease_card": "treatments", "soil_reference": "soil_reference", "equipment_manual": "equipment_manual",
}
SNIPPET, OVERLAP = 320, 40


def follow_up(kind):
    out = F.lit("")
    for key, value in FOLLOW_UP.items():
        out = F.when(kind == key, value).otherwise(out)
    return out


def citation(docs: DataFrame):
    """The first of a row's reference, citation, url, dataset and source that isn't blank."""
    held = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("source_ref", "citation", "source_url", "dataset", "source") if c in docs.columns]
    return F.coalesce(*held, F.lit(""))


def dataset_provenance(docs: DataFrame) -> DataFrame:
    """(doc_id, dataset, original_doc_id): a document's own dataset and those of its later copies, each dataset once."""
    own = docs.select("doc_id", F.struct(F.lit(0).alias("o"), F.col("dataset"), F.col("doc_id").alias("original")).alias("p"))
    extra = docs.select("doc_id", F.posexplode("also_seen_in").alias("k", "x")).select("doc_id", F.struct((F.col("k") + 1).alias("o"), F.col("x.dataset").alias("dataset"), F.col("x.doc_id").alias("original")).alias("p"))
    rows = own.unionByName(extra).where("p.dataset is not null and p.dataset <> ''")
    return rows.groupBy("doc_id", F.lower("p.dataset").alias("key")).agg(F.min("p").alias("p")).select("doc_id", "p.dataset", F.col("p.original").alias("original_doc_id"))


class KnowledgeBase:
    """documents: doc_id, source, kind, title, text and whichever metadata columns there are; the other tables are optional."""

    def __init__(self, documents: DataFrame, vectors: DataFrame | None = None, dictionary: DataFrame | None = None, symptoms: DataFrame | None = None):
        self.documents, self.vectors, self.dictionary, self.symptoms = documents, vectors, dictionary, symptoms

    @classmethod
    def open(cls, store, version: str | None = None) -> "KnowledgeBase":
        """A pinned version of a store; without usable vectors it works on words alone."""
        from larkfield.operators.dense import validity

        version = version or store.current()
        vectors, terms, symptoms = (store.read(name, version) if store.has(name, version) else None for name in ("vectors", "terms", "symptoms"))
        if vectors is not None and not validity(vectors).first()["usable"]:
            vectors = None
        return cls(store.read("documents", version), vectors, terms, symptoms)

    def search(self, queries: DataFrame, top_k: int = 5, sources=None, kinds=None, lang=None, meta=None, ids=None, expand: bool = True) -> DataFrame:
        """Hits of queries (query_id, query_text, perhaps query_vector) among the candidates that the filters allow."""
        if expand and self.dictionary is not None:
            queries = expand_queries(queries, self.dictionary)
        chosen = filters.allowed(self.documents, {"source": sources, "kind": kinds, "lang": lang}, meta, ids)
        vectors = self.vectors if "query_vector" in queries.columns else None
        return fusion.hybrid_search(queries, self.documents, vectors, chosen, top_k, title_col="title")

    def evidence(self, queries: DataFrame, top_k: int = 3, **options) -> DataFrame:
        """Hits with their best snippet, citation and the question to ask next; at most ten for each query."""
        hits = self.search(queries, max(1, min(top_k, 10)), **options)
        docs = self.documents.withColumn("citation", citation(self.documents))
        rows = hits.join(docs, "doc_id").join(queries.select("query_id", query_terms(F.col("query_text")).alias("asked")), "query_id")
        pieces = rows.select("query_id", "doc_id", "asked", F.posexplode(chunk_udf(SNIPPET, OVERLAP)("text")).alias("pos", "piece"))
        pieces = pieces.withColumn("shared", F.size(F.array_intersect("asked", query_terms(F.col("piece"))))).withColumn("hit", F.struct("query_id", "doc_id"))
        best = corpus.best_piece(pieces, "hit", F.col("shared"), "pos").select("query_id", "doc_id", snippet(F.col("piece"), SNIPPET).alias("snippet"))
        return rows.join(best, ["query_id", "doc_id"], "left").select(
            "query_id", "doc_id", "source", "kind", "title", "snippet", F.length("text").alias("full_text_chars"), "citation", "how", "rank", follow_up(F.col("kind")).alias("follow_up")
        )

    def missing(self, sources: Iterable[str] = (), kinds: Iterable[str] = ()) -> list[str]:
        """Filters that name what isn't loaded, so that an empty answer has a reason."""
        out = []
        for column, wanted in (("source", sources), ("kind", kinds)):
            wanted = list(wanted)
            if wanted:
                have = {r[0] for r in self.documents.where(F.col(column).isin(wanted)).select(column).distinct().collect()}  # no more than were asked for
                out += [f"{column} {w} is not loaded" for w in wanted if w not in have]
        return out

    def document(self, doc_id: str) -> DataFrame:
        """One exact document or none; never a near one."""
        return self.documents.where(F.col("doc_id") == doc_id)

    def catalog(self) -> DataFrame:
        return corpus.catalog(self.documents, "source", "kind", F.col("source") == "seed")

    def soil_reference(self, site_id: str, top_k: int = 5) -> DataFrame:
        rows = self.documents.where("kind = 'soil_reference'")
        template = F.coalesce(F.col("is_template"), F.lit(False)) if "is_template" in rows.columns else None
        return identity.exact_records(rows, {"site_id": site_id}, ["doc_id"], template, F.col("source") == "seed", top_k)

    def equipment_manual(self, device_id: str, fault_code: str, top_k: int = 5) -> DataFrame:
        """Records of a device, named by id, alias or model, and a fault; its type alone finds nothing."""
        rows = self.documents.where("kind = 'equipment_manual'")
        held = lambda *names: tuple(c for c in names if c in rows.columns)
        device = held("device_id", "device_ids", "device_aliases", "device_model", "model", "model_id")
        return identity.exact_records(rows, {device: device_id, held("fault_code", "fault_codes"): fault_code}, ["doc_id"], None, F.col("source") == "seed", top_k)

    def parents(self, queries_hits: DataFrame) -> DataFrame:
        """(query_id, parent_id, doc_id, kind) of all documents that share a parent with a hit (query_id, doc_id)."""
        parent = self.documents.select("doc_id", "parent_id").where("parent_id <> ''")
        asked = queries_hits.join(parent, "doc_id").select("query_id", "parent_id").distinct()
        return asked.join(self.documents.select("parent_id", "doc_id", "kind"), "parent_id").select("query_id", "parent_id", "doc_id", "kind")

    def diagnosis_evidence(self, hits: DataFrame) -> DataFrame:
        """(query_id, identity, names, score, evidence): what supports each identity of hits (query_id, identity, doc_id, score), best first."""
        rows = hits.join(self.documents.select("doc_id", "title", "kind"), "doc_id")
        piece = F.struct((-F.col("score")).alias("o"), "doc_id", "kind", "title")
        out = rows.groupBy("query_id", "identity").agg(  # a query's hits, of which there are as many as were asked for
            F.max("score").alias("score"), F.array_sort(F.collect_set("title")).alias("names"), F.array_sort(F.collect_set(piece)).alias("e")
        )
        return out.select("query_id", "identity", "names", "score", F.transform("e", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["kind"].alias("kind"))).alias("evidence"))

    def diagnose(self, queries: DataFrame, top_k: int = 5, ids=None) -> DataFrame:
        """Symptom matches of the graph and text hits of diagnostic kinds that words support, fused by identity."""
        hits = self.search(queries, max(4 * top_k, 12), kinds=("symptom", "disease_card", "diagnosis"), ids=ids).where("bm25_score > 0")
        named = F.coalesce(F.col("disease"), F.col("title")) if "disease" in self.documents.columns else F.col("title")
        text = hits.join(self.documents.select("doc_id", named.alias("identity")), "doc_id").select("query_id", F.lower("identity").alias("identity"), "rank")
        graph = text.where(F.lit(False))
        if self.symptoms is not None:
            everything = 1 << 30
            graph = kg.match_symptoms(queries, self.symptoms, top_k=everything).select("query_id", F.lower("entity").alias("identity"), "rank")
        return domain.diagnose(graph, text, top_k)

    def probe(self, questions: Iterable[str]) -> list[str]:
        """Smoke questions that find nothing."""
        asked = list(questions)
        q = self.documents.sparkSession.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")
        found = {r.query_id for r in self.search(q, 1).select("query_id").collect()}
        return [t for k, t in enumerate(asked) if k not in found]
