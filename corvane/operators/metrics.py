"""Retrieval quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def _gained(ranked: DataFrame, judged: DataFrame, k: int, on: list[str]) -> DataFrame:
    rows = ranked.where(F.col("rank") <= k).join(judged, on, "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    good = F.col("gain") > 0
    return rows.groupBy("query_id").agg(F.sum(good.cast("int")).alias("hits"), F.count("*").alias("n"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))


def _scores(got: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return got.select("query_id", ratio("hits", "n").alias("precision"), ratio("hits", "relevant").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), ratio("dcg", "ideal").alias("ndcg"))


def _ideal(place, k: int):
    return F.sum(F.when(place <= k, F.col("gain") / F.log2(place + 1))).alias("ideal")


def evaluate(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """precision, recall, reciprocal rank and NDCG at k of each query.

    ``ranked``: query_id, item, rank; ``judged``: query_id, item, gain, where a
    gain above 0 is relevant.  NDCG compares with the ideal order of the gains.
    """
    best = judged.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item")))
    best = best.groupBy("query_id").agg(F.sum((F.col("gain") > 0).cast("int")).alias("relevant"), _ideal(F.col("r"), k))
    return _scores(_gained(ranked, judged, k, ["query_id", "item"]).join(best, "query_id", "left"))


def evaluate_shared(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The same where one set of judgements (item, gain) holds for all queries; only its k best gains reach the driver."""
    gains = [r[0] for r in labels.orderBy(F.desc("gain"), "item").limit(k).select("gain").collect()]
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate(gains))
    relevant = labels.where("gain > 0").count()
    return _scores(_gained(ranked, labels, k, ["item"]).withColumns({"relevant": F.lit(relevant), "ideal": F.lit(float(ideal))}))


def quality(scored: DataFrame) -> DataFrame:
    """One row for each query: mean and best similarity and a verdict."""
    mean = F.avg("score")
    verdict = F.when(mean > 0.5, "GOOD").when(mean > 0.3, "OK").otherwise("POOR")
    return scored.groupBy("query_id").agg(F.count("*").alias("n_results"), mean.alias("avg_score"), F.max("score").alias("top_score"), verdict.alias("verdict"))


def rating(score) -> F.Column:
    """The word for one similarity."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c > 0.7, "HIGH").when(c > 0.5, "GOOD").when(c > 0.3, "OK").otherwise("LOW")


# Dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 0.15, 0.60


def savings(usage: DataFrame) -> DataFrame:
    """Usage rows (total_tokens of the corpus, sent_tokens, answer_tokens) with reduction and costs."""
    full = F.col("total_tokens") / 1e6 * PRICE_IN
    spent = F.col("sent_tokens") / 1e6 * PRICE_IN + F.col("answer_tokens") / 1e6 * PRICE_OUT
    saved = F.coalesce(100 * (1 - F.try_divide(F.col("sent_tokens").cast("double"), F.col("total_tokens"))), F.lit(0.0))
    return usage.withColumns({"saved_percent": saved, "full_cost": full, "cost": spent})
