"""What outside services have to offer, and embedding through them."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corvane.config import EmbeddingConfig
from corvane.functions import vector


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


# Addresses of services and dimensions of models.
BASES = {"openai": "https://api.openai.com/v1", "deepseek": "https://api.deepseek.com/v1", "jina": "https://api.jina.ai/v1", "ollama": "http://localhost:11434/v1"}
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384}
MOST_TEXTS = 100


def _post(url: str, body: dict, key: str, timeout: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def http_embedder(config: EmbeddingConfig, post=_post) -> Embedder:
    """An embedding service that speaks the common JSON form; at most 100 texts a request, placed by the returned index."""
    base = config.base_url or BASES[config.provider]
    key = os.environ.get(config.api_key_env, "")

    def run(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = [[] for _ in texts]
        step = min(config.batch_size, MOST_TEXTS)
        for at in range(0, len(texts), step):
            answer = post(f"{base}/embeddings", {"model": config.model, "input": texts[at : at + step]}, key, 120 if config.provider == "ollama" else 60)
            for item in answer["data"]:
                out[at + item["index"]] = item["embedding"]
        return out

    return run


def http_reranker(base: str, model: str, key: str, post=_post) -> Reranker:
    """A re-ranking service; at most 1000 texts."""

    def run(query: str, texts: list[str]) -> list[float]:
        answer = post(f"{base}/rerank", {"model": model, "query": query, "documents": texts[:1000]}, key, 60)
        scores = [0.0] * len(texts)
        for item in answer["results"]:
            scores[item["index"]] = item["relevance_score"]
        return scores

    return run


class Chat:
    """A chat service that counts its calls and tokens (four characters each)."""

    def __init__(self, base: str, model: str, key: str = "", post=_post):
        self.base, self.model, self.key, self.post = base, model, key, post
        self.calls = self.tokens_in = self.tokens_out = 0

    def __call__(self, prompt: str, system: str = "") -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        answer = self.post(f"{self.base}/chat/completions", {"model": self.model, "messages": messages, "temperature": 0.7, "max_tokens": 2000}, self.key, 120)
        said = answer["choices"][0]["message"]["content"]
        self.calls += 1
        self.tokens_in += sum(len(m["content"].encode()) for m in messages) // 4
        self.tokens_out += len(said.encode()) // 4
        return said


def embed_chunks(chunks: DataFrame, embedder: Embedder | None, dim: int, known: DataFrame | None = None, batch: int = MOST_TEXTS, lenient: bool = False) -> DataFrame:
    """id and vector of passages that have none yet; without an embedder by the stand-in, natively.

    ``lenient``: texts of a request that fails get a null vector.
    """
    rows = chunks if known is None else chunks.join(known.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    if embedder is None:
        return rows.select(F.col("chunk_id").alias("id"), vector.mock_embedding("text", dim).alias("vector"))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for at in range(0, len(texts), batch):
                some = texts.iloc[at : at + batch].tolist()
                try:
                    out += embedder(some)
                except Exception:
                    if not lenient:
                        raise
                    out += [None] * len(some)
            yield pd.Series(out)

    return rows.select(F.col("chunk_id").alias("id"), run("text").alias("vector"))
