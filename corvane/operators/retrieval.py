"""Keyword, vector and hybrid scoring of passages, many queries in one job.

A query frame has query_id and text (or vector); a result has query_id,
chunk_id, score and rank.  Ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import stem, text as tx, vector
from corvane.operators import index

#: A side of at most so many rows is broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 20_000
#: So many query vectors at most are sent to every vector; more are compared in tiles of so many queries and vectors.
MOST_QUERIES, TILE = 2000, 4096
#: Stands among the wanted terms for the passage itself: no token is empty.
ITSELF = ""
#: Sums of parts in any order agree to so many digits: equal passages get equal scores and an order by id.
DIGITS = 9


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether counting finds at most so many rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint, if counting finds it small."""
    return F.broadcast(df) if is_small(df, most) else df


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query, with rank; the limit acts before the exchange."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, stemming: bool = False) -> DataFrame:
    """query_id, term and how often the query repeats it."""
    tokens = tx.tokenize("text")
    tokens = stem.stem_tokens(tokens) if stemming else tokens
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def idf(n_total: Column, n_term: Column) -> Column:
    return F.log((n_total - n_term + 0.5) / (n_term + 0.5) + 1)


def saturation(tf: Column, dl: Column, avg: Column, k1: float, b: float) -> Column:
    return F.try_divide(tf * (k1 + 1), tf + k1 * (1 - b + b * F.coalesce(F.try_divide(dl, avg), F.lit(0.0))))


def path_boost(path: Column, terms: Column) -> Column:
    """Parts of a path (with repeats) among the query's distinct terms, for each of these."""
    return F.coalesce(F.try_divide(F.size(F.filter(tx.path_tokens(path), lambda t: F.array_contains(terms, t))), F.size(terms)), F.lit(0.0))


def term_hits(chunks: DataFrame, terms: DataFrame, few: bool, keep: tuple[str, ...] = (), distinct: bool | None = None) -> DataFrame:
    """term, chunk_id, dl, tf and the columns ``keep`` of the wanted terms (broadcast if ``few``), and a row of the term ``ITSELF`` for every passage.

    One pass over the passages gives all that scoring needs.  Terms are
    counted inside their passage; only the rows of wanted terms leave it, and
    meet again by passage, so a sum over the terms of a passage needs no other
    shuffle.  Passages of the same id (looked for unless ``distinct`` is
    given) are counted as one.
    """
    chunks = chunks.where("chunk_id is not null")
    if distinct is None:
        distinct = not index.repeats(chunks, "chunk_id")
    wanted = terms.select("term").union(terms.sparkSession.createDataFrame([(ITSELF,)], "term string")).distinct()
    itself = F.array(F.struct(F.lit(ITSELF).alias("term"), F.lit(1).cast("long").alias("tf")))
    rows = index.counted(chunks.select("chunk_id", *keep, F.size("tokens").alias("dl"), "tokens"), "chunk_id", "dl", *keep, extra=itself)
    hits = rows.join(F.broadcast(wanted) if few else wanted, "term").select("term", "chunk_id", "dl", *keep, "tf").repartition("chunk_id")
    return hits if distinct else hits.groupBy("term", "chunk_id", "dl", *keep).agg(F.sum("tf").alias("tf"))


def whole(hits: DataFrame) -> Column:
    """True, but of every column: a use that needs few of them would have the others cut off below the shuffle, and so a shuffle and a pass of its own."""
    return F.size(F.array(*[F.col(c).cast("string") for c in hits.columns])) > 0


def totals_of(hits: DataFrame) -> DataFrame:
    """One row: passages and their mean tokens, from the rows of ``ITSELF``."""
    own = lambda c: F.sum(F.when((F.col("term") == ITSELF) & whole(hits), c)).cast("double")  # noqa: E731  a filter would part this from the other uses of hits
    return hits.agg(own(F.col("tf")).alias("total"), F.coalesce(F.try_divide(own(F.col("dl") * F.col("tf")), own(F.col("tf"))), F.lit(0.0)).alias("mean"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, path_weight: float = 0.0, stemming: bool = False, posted: DataFrame | None = None, keep: tuple[str, ...] = (), distinct: bool | None = None) -> DataFrame:
    """The k best passages of each query by BM25, boosted by path parts, with the columns ``keep`` of the passages.

    The passages are read once: frequencies, totals and scores all come from
    the counted hits of the wanted terms, whose shuffle Spark reuses.  What is
    broadcast is bounded by the queries' own terms.  ``posted`` takes stored
    postings instead.  ``distinct`` says whether no two passages have the same
    id, if that is known.
    """
    terms = query_terms(queries, stemming)
    few = is_small(terms)
    hint = F.broadcast if few else lambda df: df
    carried = tuple(dict.fromkeys((*keep, "path") if path_weight else keep))
    if posted is None:
        hits = term_hits(chunks, terms, few, carried, distinct)
        totals, held = totals_of(hits), whole(hits)
    else:
        size = F.col("dl") if "dl" in chunks.columns else F.size("tokens")
        hits = posted.join(hint(terms.select("term").distinct()), "term")
        if carried or "dl" not in posted.columns:  # postings with the passage's length need no other table
            hits = hits.drop("dl").join(chunks.select("chunk_id", *carried, size.alias("dl")), "chunk_id")
        totals = chunks.agg(F.count("*").cast("double").alias("total"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"))
        held = F.lit(True)
    freq = hits.groupBy("term").agg(F.sum(F.when((F.col("tf") > 0) & held, 1)).alias("n_term"))
    weighted = terms.join(freq, "term").crossJoin(F.broadcast(totals)).withColumn("idf", idf(F.col("total"), F.col("n_term")))
    if path_weight:
        sets = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
        weighted = weighted.join(sets, "query_id")
    part = F.col("qtf") * F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.col("mean"), k1, b)
    scored = hits.join(hint(weighted), "term").groupBy("query_id", "chunk_id", *carried, *(["terms"] if path_weight else [])).agg(F.round(F.sum(part), DIGITS).alias("score"))
    if path_weight:
        scored = scored.withColumn("score", F.col("score") * (1 + path_boost(F.col("path"), F.col("terms")) * path_weight))
    return top(scored.select("query_id", "chunk_id", *keep, "score"), k)


def single_chunk_bm25(queries: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of pairs in which every term counts as held by one passage alone."""
    terms = query_terms(queries)
    few = is_small(terms)
    hits = term_hits(chunks, terms, few, keep)
    rows = hits.join(F.broadcast(terms) if few else terms, "term").crossJoin(F.broadcast(totals_of(hits)))
    part = F.col("qtf") * idf(F.col("total"), F.lit(1.0)) * saturation(F.col("tf"), F.col("dl"), F.col("mean"), k1, b)
    return rows.groupBy("query_id", "chunk_id", *keep).agg(F.sum(part).alias("score"))


def with_columns_of(found: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, *columns: str) -> DataFrame:
    """``found``, k rows at most of each query, with columns of its passages; few enough rows are sent to the passages."""
    return chunks.select("chunk_id", *columns).join(F.broadcast(found) if is_small(queries, SMALL_ROWS // k) else found, "chunk_id")


def vector_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of largest cosine for each query vector; raises if the dimensions differ.

    A few queries are sent to every vector.  More are cut into blocks, as the
    vectors are, and each pair of blocks meets in one task, which gives back
    the k best of its queries; that ships a vector once for every block of
    queries and a query once for every block of vectors.
    """
    if not is_small(queries, MOST_QUERIES):
        return top(_tiles(queries, vectors, k), k)
    pairs = vectors.select("id", "vector").join(F.broadcast(queries.select("query_id", F.col("vector").alias("q"))), F.lit(True), "inner")
    same = F.size("q") == F.size("vector")
    score = F.when(F.assert_true(same, "the query has another dimension than the vectors").isNull(), vector.cosine("q", "vector"))
    return top(pairs.select("query_id", F.col("id").alias("chunk_id"), score.alias("score")), k)


def _tiles(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id and score of each query's k best in every block of vectors."""
    kind = queries.schema["query_id"].dataType.simpleString()
    across, down = (-(-df.count() // TILE) for df in (queries, vectors))
    if not down:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, score double")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), block("query_id", across).alias("i"), every(down).alias("j"))
    right = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), every(across).alias("i"), block("id", down).alias("j"))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        if len({*map(len, q["vector"]), *map(len, v["vector"])}) > 1:
            raise ValueError("the query has another dimension than the vectors")
        a, b = np.stack(q["vector"]), np.stack(v["vector"])
        norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        cos = np.where(norm > 0, a @ b.T / np.where(norm > 0, norm, 1), 0.0).round(12)
        ids = v["id"].to_numpy()
        place = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(q)), place.shape[1])
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "chunk_id": ids[place.ravel()], "score": cos[rows, place.ravel()]})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"query_id {kind}, chunk_id string, score double")


def vector_subset(queries: DataFrame, vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cosines of the given (query_id, chunk_id) pairs; those without a vector are left out."""
    found = candidates.select("query_id", "chunk_id").join(vectors.select(F.col("id").alias("chunk_id"), "vector"), "chunk_id")
    found = found.join(small(queries.select("query_id", F.col("vector").alias("q"))), "query_id")
    return found.select("query_id", "chunk_id", vector.cosine("q", "vector").alias("score"))


def semantic(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Vector search; vectors without a passage are dropped after the limit."""
    found = vector_top(queries, vectors, k)
    return with_columns_of(found, chunks, queries, k).select(found.columns)


def blend(keyword: DataFrame, cosines: DataFrame, weight: float = 0.5) -> DataFrame:
    """BM25 scaled by its range among the candidates, mixed with the cosine (0 where there is none)."""
    if not 0 <= weight <= 1:
        weight = 0.5
    per = Window.partitionBy("query_id")
    low, high = F.min("bm25").over(per), F.max("bm25").over(per)
    both = keyword.select("query_id", "chunk_id", F.col("score").alias("bm25")).join(cosines.select("query_id", "chunk_id", F.col("score").alias("cos")), ["query_id", "chunk_id"], "left")
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return both.select("query_id", "chunk_id", (weight * (F.col("bm25") - low) / span + (1 - weight) * F.coalesce("cos", F.lit(0.0))).alias("score"))


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int, weight: float = 0.5, **options) -> DataFrame:
    """BM25 candidates, max(10 k, 50) of each query, blended with their cosines.

    Queries (query_id, text, vector) without a keyword hit take vectors alone;
    those whose vector is null, as their embedding failed, keep their BM25
    scores.  The candidates, a bounded list of each query, are kept for their
    several uses.
    """
    most = max(10 * k, 50)
    keyword = bm25(queries, chunks, most, **options).select("query_id", "chunk_id", "score").persist()
    keyword = F.broadcast(keyword) if is_small(queries, SMALL_ROWS // most) else keyword
    known = queries.where("vector is not null")
    here = known.select("query_id")
    mixed = blend(keyword.join(here, "query_id", "left_semi"), vector_subset(known, vectors, keyword), weight)
    plain = keyword.join(here, "query_id", "left_anti").select("query_id", "chunk_id", "score")
    missed = known.join(keyword.select("query_id").distinct(), "query_id", "left_anti")
    alone = semantic(missed, vectors, chunks, k).select("query_id", "chunk_id", "score")
    return top(mixed.unionByName(plain).unionByName(alone), k)


def reciprocal_ranks(*rankings: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Fusion of rankings by the sum of 1 / (rrf_k + rank)."""
    parts = [r.select("query_id", "chunk_id", (1 / (rrf_k + F.col("rank"))).alias("s")) for r in rankings]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def hyde(queries: DataFrame, generate: Callable[[str], str], embed: Callable[[list[str]], list[list[float]]], vectors: DataFrame, chunks: DataFrame, k: int, fallback: bool = False) -> DataFrame:
    """Semantic search for a passage that a language model writes; with ``fallback`` for the query itself if it fails.

    The models are asked where the queries are, a partition at a time.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            said = []
            for text in frame["text"]:
                try:
                    said.append(generate(f"Write a short passage that answers this question.\n\n{text}"))
                except Exception:
                    if not fallback:
                        raise
                    said.append(text)
            made = embed(said) if said else []
            yield pd.DataFrame({"query_id": frame["query_id"], "vector": [[float(x) for x in v] for v in made]})

    asked = queries.select("query_id", "text").mapInPandas(run, f"query_id {kind}, vector array<double>").persist()
    return semantic(asked, vectors, chunks, k)


def threshold(scored: DataFrame, least: float) -> DataFrame:
    """Rows that score at least ``least``; 0 switches the test off."""
    return scored.where(F.col("score") >= least) if least > 0 else scored


def symbol_search(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose name holds the text, whatever its case."""
    return symbols.where(F.contains(F.lower("name"), F.lower(F.lit(text))))


def pooled(*results: DataFrame) -> DataFrame:
    """The best score of each passage over several result sets."""
    rows = results[0].select("chunk_id", "score")
    for r in results[1:]:
        rows = rows.unionByName(r.select("chunk_id", "score"))
    return rows.groupBy("chunk_id").agg(F.max("score").alias("score"))
