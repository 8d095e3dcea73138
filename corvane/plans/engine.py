"""The engine: index documents, answer queries, pack contexts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.config import Config
from corvane.functions import text as tx
from corvane.operators import chunking, code, expand, golang, index, packing, rerank, retrieval
from corvane.plans.cache import QueryCache
from corvane.plans.ports import Embedder, embed_chunks
from corvane.sources import corpus, files
from corvane.sources.store import Store


#: Changed documents that are named.
SHOWN_CHANGES = 5


@dataclass(frozen=True)
class IndexResult:
    """What one indexing run did."""

    indexed: int
    skipped: int
    deleted: int
    chunks: int


class Engine:
    """Documents in a stored index; every method plans one Spark job over it."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.config, self.embedder = spark, config or Config(), embedder
        self.store, self.cache = Store(spark, path), QueryCache()

    # -- building

    def chunks_of(self, docs: DataFrame) -> DataFrame:
        i = self.config.index
        build = chunking.composite_chunks if i.ast_chunking else chunking.line_chunks
        return build(docs, i.chunk_tokens, i.chunk_overlap, i.stemming)

    def index(self, docs: DataFrame, whole: bool = True) -> IndexResult:
        """Bring the index to the given snapshot of documents (doc_id, path, text, mod_time, lang).

        New documents are written down before anything is made of them, so
        sources are read once and all tables agree; what is stored of others
        stays as it is.  With ``whole`` false the documents are a part of the
        snapshot: none that it leaves out is deleted.
        """
        if self.store.check(self.config).needs_rebuild:
            self.store.clear()
        fields, status = ("doc_id", "path", "text", "mod_time", "lang"), None
        if not self.store.has("docs"):
            parts = {"docs": self.store.put("docs", docs.where("path is not null").select(*fields))}
            new = self.store.part(parts["docs"])
            counts = {"insert": new.count()}
        else:
            status = index.incremental_diff(self.store.read("docs"), docs)
            status = (status if whole else status.where("status != 'delete'")).persist()
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            wanted = status.where("status in ('insert', 'update')")
            wanted = wanted if retrieval.is_small(wanted) else wanted.hint("shuffle_hash")  # texts are not sorted for it
            parts = {"docs": self.store.put("docs", docs.join(wanted, "path", "left_semi").select(*fields))}
            new = self.store.part(parts["docs"])
        parts["chunks"] = self.store.put("chunks", self.chunks_of(new).withColumn("dl", F.size("tokens")).drop("lang", "num"))
        parts["postings"] = self.store.put_postings(self.store.part(parts["chunks"]))
        marked = new.where("lang = 'go'")
        parts["symbols"] = self.store.put("symbols", golang.symbols(marked).unionByName(code.prefix_symbols(new)))
        parts["calls"] = self.store.put("calls", code.resolve_calls(golang.calls(marked), self.store.part(parts["symbols"])))
        gone = None
        if counts.get("delete", 0) + counts.get("update", 0):
            gone = self.store.gone_with(status.where("status in ('delete', 'update')").join(self.store.read("docs").select("path", "doc_id"), "path"))
        self.store.commit(self.config, parts, gone)
        if status is not None:
            status.unpersist()
        if self.config.embedding.enabled:
            self.embed()
        self.cache.invalidate()
        n = self.store.read("chunks").count()
        return IndexResult(counts.get("insert", 0) + counts.get("update", 0), counts.get("skip", 0), counts.get("delete", 0), n)

    def index_files(self, root: str) -> IndexResult:
        return self.index(files.read_documents(self.spark, root, self.config.index.includes, self.config.index.excludes))

    def index_memory(self, contents: dict[str, str]) -> IndexResult:
        return self.index(corpus.in_memory(self.spark, contents))

    def embed(self) -> None:
        """Vectors for the passages that have none."""
        known = self.store.read("vectors") if self.store.has("vectors") else None
        rows = embed_chunks(self.store.read("chunks"), self.embedder, self.config.embedding.dimension, known)
        rows = rows.withColumn("metadata", F.create_map().cast("map<string,string>"))
        self.store.upsert_vectors(self.config, rows)

    def clear(self) -> None:
        self.store.clear()
        self.cache.invalidate()

    def stats(self) -> dict:
        if not self.store.has("chunks"):
            return {"total_docs": 0, "total_chunks": 0, "avg_chunk_len": 0.0}
        return index.stats(self.store.read("chunks").select("doc_id", "dl")).first().asDict()

    def stale(self, docs: DataFrame) -> DataFrame:
        """Stored documents that the snapshot shows as changed or gone."""
        return index.changed(self.store.read("docs"), docs)

    def ensure(self, docs: DataFrame, auto: bool = True, ask: Callable[[str], bool] | None = None) -> list[str]:
        """Index if there is no index, index again if documents changed; the changed paths, five at most.

        ``ask`` is asked before either; without it the answer is yes.  With
        ``auto`` false a missing index raises and a stale one is left alone.
        """
        agreed = ask or (lambda question: True)
        if not self.store.has("docs"):
            if not auto or not agreed("No index found. Index these documents?"):
                raise LookupError("no index found")
            self.index(docs)
            return []
        if not auto:
            return []
        changed = self.stale(docs).orderBy("path").limit(SHOWN_CHANGES)
        shown = [r["path"] + (" (deleted)" if r["status"] == "delete" else "") for r in changed.collect()]
        if shown and agreed("Reindex?"):
            self.index(docs)
        return shown

    # -- answering

    def queries(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")

    def _vectors(self, queries: DataFrame, lenient: bool = False) -> DataFrame:
        """Queries with their vectors; ``lenient``: null where embedding fails."""
        asked = queries.withColumnRenamed("query_id", "chunk_id")
        rows = embed_chunks(asked, self.embedder, self.config.embedding.dimension, lenient=lenient)
        return queries.join(rows.withColumnRenamed("id", "query_id"), "query_id").persist()

    def candidates(self, queries: DataFrame, k: int, mode: str = "") -> DataFrame:
        """Ranked passages of many queries: bm25, semantic or hybrid."""
        r, i = self.config.retrieve, self.config.index
        chunks = self.store.read("chunks")
        mode = mode or ("hybrid" if r.hybrid_enabled else "bm25")
        if mode != "bm25" and not self.store.has("vectors"):
            mode = "bm25"
        options = {"k1": i.k1, "b": i.b, "path_weight": r.path_boost_weight, "stemming": i.stemming, "posted": self.store.read("postings")}
        if mode == "bm25":
            return retrieval.bm25(queries, chunks, k, **options)
        vectors = self.store.read("vectors")
        if mode == "semantic":
            return retrieval.semantic(self._vectors(queries), vectors, chunks, k)
        return retrieval.hybrid(self._vectors(queries, lenient=True), chunks, vectors, k, r.bm25_weight, **options)

    def retrieve(self, queries: DataFrame, k: int = 0, mode: str = "", diverse: bool = True) -> DataFrame:
        """Passages with path, lines, score, text and time; diversity chooses k of twice as many and the threshold follows.

        What is found, a bounded list of each query, is sent to the stored passages rather than these to it.
        """
        r = self.config.retrieve
        k = k or r.top_k
        chunks = self.store.read("chunks")
        found = self.candidates(queries, 2 * k if diverse else k, mode).select("query_id", "chunk_id", "score", "rank")
        if diverse:
            found = retrieval.with_columns_of(found, chunks, queries, 2 * k, "tokens")
            found = retrieval.threshold(rerank.mmr(found, k, r.mmr_lambda, r.dedup_jaccard), r.min_score_threshold)
        found = retrieval.with_columns_of(found, chunks, queries, k, "doc_id", "path", "start_line", "end_line", "text", "mod_time")
        return found.select("query_id", "rank", "chunk_id", "doc_id", "path", "start_line", "end_line", "score", "text", "mod_time")

    def query(self, text: str, k: int = 0, mode: str = "", diverse: bool = True, context: int = 0) -> list:
        """Rows for one question, from the cache if it was asked before."""
        k = k or self.config.retrieve.top_k

        def run():
            found = self.retrieve(self.queries(text), k, mode, diverse)
            if context:
                found = expand.around(found, self.store.read("docs"), context)
            return found.orderBy("rank").collect()

        return self.cache.cached(f"{mode}|{diverse}|{context}|{text}", k, run)

    def pack(self, queries: DataFrame, budget: int = 0, k: int = 0) -> DataFrame:
        """Contexts of many queries, from keyword search."""
        p = self.config.pack
        found = self.retrieve(queries, k, mode="bm25")
        return packing.packed_context(queries, found, self.store.read("docs"), budget or p.token_budget, p.recency_boost)

    def pack_json(self, text: str, budget: int = 0, path: str | None = None, k: int = 0) -> str:
        """One packed context as indented JSON, also written to ``path`` if it is given and anything was found."""
        packed = self.pack(self.queries(text), budget, k)
        said = packing.context_json(packed).first()["json"]
        if path is not None and json.loads(said)["snippets"]:
            Path(path).write_text(said + "\n", encoding="utf-8")
        return said

    def prompt(self, text: str, template: str = "runtime") -> str:
        return packing.prompts(self.pack(self.queries(text)), template).first()["prompt"]

    def result_json(self, text: str, k: int = 5) -> str:
        """Results as indented JSON; texts cut at 500 bytes."""
        found = self.retrieve(self.queries(text), k).withColumn("text", tx.preview("text", 500))
        rows = F.array_sort(F.collect_list(F.struct("rank", "path", "start_line", "end_line", "score", "text")))
        return found.agg(F.to_json(rows, {"pretty": "true"}).alias("json")).first()["json"]
