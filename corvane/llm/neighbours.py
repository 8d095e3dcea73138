"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to a grid of tiles by hashes of their ids;
the tile is the join key, and a tile's sides are bounded by the grid, whatever
the table.  In a tile every vector is quantised to int8; products of int8
blocks (exact in float32 for up to 1,000 dimensions, split beyond) times the
scales differ from the true inner product of x and y by at most
|x - x'| |y| + |x'| |y - y'|, with the true residuals.  Pairs whose upper bound
reaches the query's k-th best lower bound so far are computed in double
precision on the original vectors, one dimension after the other, and kept in
a heap for each query; the heaps of a query's tiles are merged at last.  No
neighbour can be lost, so recall is 1.  Every candidate is sent once for each
``TILE_QUERIES`` queries and every query once for each ``TILE_CANDIDATES``
candidates: as queries are a share of the vectors, the join's work grows with
the square of the table, spread over as many tasks as there are tiles.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part, nor does a null vec_id; rows that repeat a vec_id
count once, with the smallest of their vectors; vectors of different lengths
are not compared; ties go to the smaller vec_id; with fewer than k candidates
all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import table

K = 20
#: Most queries and candidates of a tile, on average over the hash.
TILE_QUERIES, TILE_CANDIDATES = 8192, 65536
#: Candidates of one product block; queries of one.
BLOCK = 2048
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors in double precision."""
    ids = t.column("vec_id").to_numpy()
    vectors = t.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _quantised(x: np.ndarray):
    """int8 codes, scales, norms of the rounded vectors and of the residuals."""
    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0  # below what a double can divide: the residual holds all of it
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, through float32 sums that stay below 2**24."""
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], 1000):
        out += a[:, at : at + 1000].astype(np.float32) @ b[:, at : at + 1000].astype(np.float32).T
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs, summed in the order of the dimensions."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def search_tile(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within one tile: query index, candidate index, score."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    if len(q_ids) and len(c_ids):
        qs, cs = _quantised(q), _quantised(c)
        q_norm = np.linalg.norm(q, axis=1)
        slack = 1e-12 * q_norm.max() * np.linalg.norm(c, axis=1).max()  # double rounding
        for qa in range(0, len(q_ids), BLOCK):
            part = slice(qa, qa + BLOCK)
            floor = np.full(len(q_ids[part]), -np.inf)  # the k-th best lower bound so far
            best = np.full((len(floor), 0), -np.inf)
            for ca in range(0, len(c_ids), BLOCK):
                block = slice(ca, ca + BLOCK)
                about = int8_products(qs[0][part], cs[0][block]) * qs[1][part, None] * cs[1][block]
                error = q_norm[part, None] * cs[3][block] + qs[3][part, None] * cs[2][block] + slack
                own = q_ids[part, None] == c_ids[block]
                low = np.where(own, -np.inf, about - error)
                best = np.concatenate([best, low], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
                    floor = best.min(1)
                i, j = np.nonzero((about + error >= floor[:, None]) & ~own)
                if not len(i):
                    continue
                score = np.concatenate([exact_scores(q[qa + i[s : s + 65536]], c[ca + j[s : s + 65536]]) for s in range(0, len(i), 65536)])
                # Of each query the k best of this block go to its heap; ids ascend with j.
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                few = np.arange(len(i)) - first < k
                for a, b, x in zip((qa + i[few]).tolist(), (ca + j[few]).tolist(), score[few].tolist(), strict=True):
                    heap = heaps[a]
                    if len(heap) < k:
                        heapq.heappush(heap, (x, -b))
                    elif (x, -b) > heap[0]:
                        heapq.heapreplace(heap, (x, -b))
    found = [(a, -b, x) for a, heap in enumerate(heaps) for x, b in heap]
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    a, b, x = zip(*found)
    return np.array(a), np.array(b), np.array(x)


def usable(vec: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest candidates of every query, by inner product."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.when(is_query, 1)).alias("q")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = -(-(size["q"] or 1) // TILE_QUERIES)
    down = max(-(-size["n"] // TILE_CANDIDATES), min(tasks, -(-size["n"] // BLOCK)), 1)
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where(is_query).select("vec_id", "embedding", "dim", deal(across, 1).alias("a"), every(down).alias("b"))
    right = rows.select("vec_id", "embedding", "dim", deal(down, 2).alias("b"), every(across).alias("a"))

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _OUT.empty_table()
        (q_ids, qv), (c_ids, cv) = _matrix(q), _matrix(c)
        a, b, x = search_tile(q_ids, qv, c_ids, cv, k)
        return pa.table([q_ids[a], c_ids[b], x], schema=_OUT)

    found = left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInArrow(tile, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vec_id that 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
