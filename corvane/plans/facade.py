"""A small interface for embedding in other programs: named contents in, JSON out, errors as values."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from corvane.config import Config, overlay
from corvane.functions import text as tx
from corvane.plans.engine import Engine
from corvane.sources import corpus

#: Passages of contents given one by one are smaller than those of files.
SMALL_CHUNKS = {"index": {"chunk_tokens": 256, "chunk_overlap": 50, "ast_chunking": False}}


def _answer(method: Callable[..., dict]) -> Callable[..., str]:
    @functools.wraps(method)
    def run(self, *args, **options) -> str:
        try:
            return json.dumps(method(self, *args, **options), ensure_ascii=False)
        except Exception as failed:
            return json.dumps({"error": f"{method.__name__} failed: {failed}"}, ensure_ascii=False)

    return run


class Facade:
    """Every method returns JSON text; what fails returns {"error": ...}."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.engine = Engine(spark, path, config or overlay(Config(), SMALL_CHUNKS))

    @_answer
    def index(self, name: str, content: str) -> dict:
        """Add one named content, or put it in the place of the one of that name."""
        engine = self.engine
        docs = corpus.in_memory(engine.spark, {name: content})
        if engine.store.has("docs") and not engine.store.check(engine.config).needs_rebuild:
            engine.store.delete_docs(engine.config, docs.select("doc_id"))
        engine.index(docs, whole=False)
        made = engine.store.doc_chunks(docs.select(tx.doc_id("path")).first()[0]).count()
        return {"success": True, "chunks": made, "filename": name}

    @_answer
    def query(self, query: str, k: int = 5) -> dict:
        """The k best diverse passages of twice as many candidates."""
        if not self.engine.store.has("chunks"):
            return {"results": [], "query": query}
        found = self.engine.query(query, k, mode="bm25")
        return {"results": [{"path": r["path"], "startLine": r["start_line"], "endLine": r["end_line"], "score": r["score"], "text": r["text"]} for r in found], "query": query}

    @_answer
    def clear(self) -> dict:
        self.engine.clear()
        return {"success": True}

    @_answer
    def stats(self) -> dict:
        found = self.engine.stats()
        names = self.engine.store.read("docs").select(F.sort_array(F.collect_list("path"))).first()[0] if self.engine.store.has("docs") else []
        return {"totalDocs": found["total_docs"], "totalChunks": found["total_chunks"], "avgChunkLen": found["avg_chunk_len"], "files": names}
