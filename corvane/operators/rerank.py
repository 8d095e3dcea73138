"""Diversity and term-overlap re-ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import text as tx
from corvane.operators.retrieval import small, top


def jaccard(a, b) -> Column:
    """Similarity of two token sets: 1 if both are empty, 0 if one is."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def select_diverse(scores: list[float], tokens: list[list[str]], k: int, trade: float = 0.7, dedup: float = 0.8) -> list[int]:
    """Greedy choice by relevance less similarity to what is chosen; near-copies are passed over."""
    sets = [set(t) for t in tokens]
    highest = max(scores, default=0.0)
    scale = highest if highest > 0 else 1.0
    nearest = [0.0] * len(scores)
    open_, chosen = list(range(len(scores))), []
    while open_ and len(chosen) < k:
        fit = [i for i in open_ if nearest[i] <= dedup]
        if not fit:
            break
        best = max(fit, key=lambda i: trade * scores[i] / scale - (1 - trade) * nearest[i])
        chosen.append(best)
        open_.remove(best)
        for i in open_:
            union = len(sets[i] | sets[best])
            nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / union if union else 1.0)
    return chosen


def mmr(candidates: DataFrame, k: int, trade: float = 0.7, dedup: float = 0.8) -> DataFrame:
    """query_id, chunk_id, score and new rank of the diverse choice.

    Candidates (query_id, chunk_id, score, rank, tokens) are a top list of each
    query, so a group is bounded by its limit.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        picked = select_diverse(group["score"].tolist(), group["tokens"].tolist(), k, trade, dedup)
        out = group.iloc[picked][["query_id", "chunk_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    kind = candidates.schema["query_id"].dataType.simpleString()
    rows = candidates.select("query_id", "chunk_id", "score", "rank", "tokens")
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, score double, rank int")


def overlap_scores(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of the query's distinct ASCII words in each candidate's text.

    A query without words scores by position, 1 - 0.01 each; an empty text 0.
    """
    asked = queries.select("query_id", F.array_distinct(tx.simple_tokens("text")).alias("q"))
    rows = candidates.join(small(asked), "query_id").withColumn("d", F.array_distinct(tx.simple_tokens("text")))
    score = F.when(F.size("q") == 0, 1 - 0.01 * (F.col("rank") - 1)).when(F.size("d") == 0, 0.0).otherwise(F.size(F.array_intersect("q", "d")) / F.greatest(F.size("q"), F.lit(1)))
    return rows.select("query_id", "chunk_id", score.alias("score"))


def rerank(candidates: DataFrame, queries: DataFrame, k: int, pool: int = 50, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """The k best of the first ``pool`` candidates after re-scoring.

    ``scorer`` stands for an outside service: it takes a query and its texts
    (1000 at most), one query's pool at a time; if it fails, the order stays.
    """
    first = candidates.where(F.col("rank") <= pool)
    if scorer is None:
        return top(overlap_scores(first, queries), k)
    kind = candidates.schema["query_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        try:
            group = group.head(1000).assign(score=scorer(group["asked"].iloc[0], group["text"].head(1000).tolist()))
            group = group.sort_values(["score", "chunk_id"], ascending=[False, True])
        except Exception:
            pass
        out = group.head(k)[["query_id", "chunk_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    rows = first.select("query_id", "chunk_id", "score", "rank", "text").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, score double, rank int")
