"""Document fingerprints by winnowing.

Every run of ``K`` code points gets a rolling hash; of each window of ``W``
consecutive hashes the smallest is selected, the rightmost one of equals, and
its position is kept.  Two texts that share a passage of at least
``W + K - 1`` code points therefore share a selected hash, and no match
shorter than ``K`` is ever reported.

Defined results: a text shorter than ``K`` is one gram; fewer than ``W`` grams
are one window; an empty or null text has the empty fingerprint.  Two empty
fingerprints have likeness 1, an empty and another one 0.  A null doc_id comes
after all others in descending order; rows that repeat a doc_id are ordered by
text; a lone document is its own successor; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import table, tune

K = 12
W = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Grams of one numpy block: bounds memory for texts of any length.
_BLOCK_BITS = 18
_BLOCK = 1 << _BLOCK_BITS
_LOW = np.uint64(_BLOCK - 1)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _BLOCK + 4 * K
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of k code points: differences of one prefix sum."""
    up, down = _powers()
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every window of w values, by doubling."""
    width = 1
    while 2 * width <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (w - width)], values[w - width :]) if width < w else values


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Selected 46-bit hashes and their positions, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    w = min(w, grams)
    hashes, places, at = [], [], 0
    while True:
        upto = min(at + _BLOCK, grams)
        h = _gram_hashes(points[at : upto + k - 1], k)
        # A larger position has the smaller low bits: of equal hashes the rightmost wins.
        least = _window_minima((h & ~_LOW) | (_LOW - np.arange(upto - at, dtype=np.uint64)), w)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        hashes.append(least >> np.uint64(_BLOCK_BITS))
        places.append((_LOW - (least & _LOW)).astype(np.int64) + at)
        if upto == grams:
            break
        at = upto - w + 1
    if len(hashes) == 1:
        return hashes[0], places[0]
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], places


def as_string(hashes: np.ndarray, places: np.ndarray) -> str:
    """Twenty hex digits for each selection: twelve of hash, eight of position."""
    out = np.empty((len(hashes), 10), np.uint8)
    out[:, :6] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    out[:, 6:] = places.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part (intersection over union) of two fingerprints' distinct hashes, each sorted."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def _prints(text: str, k: int, w: int):
    h, p = fingerprint(text, k, w)
    return h, p, np.unique(h)


# --- neighbours in descending doc_id order ------------------------------------


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Index of the range that holds ``key``: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    cuts = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(key >= F.get(cuts, at + s - 1), F.lit(False)), at + s).otherwise(at))


def with_successor(docs: DataFrame, per_task, schema: str, ranges: int | None = None) -> DataFrame:
    """``per_task`` over runs of documents in descending doc_id order, each run followed by its successor.

    The keys alone are read first, for range bounds and the first key of each
    range; the texts are then dealt out once.  Only the first document of a
    range travels twice, to serve as the successor of the range before.
    """
    spark = docs.sparkSession
    tune(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or 4 * tasks
    cuts = rows.select(key.alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(x) for x in cuts})
    at = _bucket(key, bounds)
    tops = {r[0]: r[1] for r in rows.groupBy(at.alias("at")).agg(F.max(key)).collect()}  # one row a range
    full = sorted(tops)
    above = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    size = len(bounds) + 1
    top_of = F.array(*[F.lit(tops.get(i)).cast("long") for i in range(size)])
    above_of = F.array(*[F.lit(above.get(i, 0)) for i in range(size)])
    here = F.struct(F.col("at").alias("at"), F.lit(0).alias("look"))
    ahead = F.struct(F.get(above_of, F.col("at")).alias("at"), F.lit(1).alias("look"))
    sent = rows.withColumn("key", key).withColumn("at", at)
    sent = sent.withColumn("to", F.explode(F.when(F.get(top_of, F.col("at")) == F.col("key"), F.array(here, ahead)).otherwise(F.array(here))))
    sent = sent.select("to.at", "to.look", "key", "doc_id", "text").repartition(tasks, "at")
    sent = sent.sortWithinPartitions("at", "look", F.desc("key"), "text").select("at", "look", "doc_id", "text")
    return sent.mapInArrow(per_task, schema)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(k: int, w: int):
    def row(doc_id, text, own, after, other):
        n = len(text)
        cut = n // 3
        edited = text[: n - cut] + after[:cut]
        eh, ep, es = own if edited == text else _prints(edited, k, w)
        return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_string(own[0], own[1]), as_string(eh, ep), likeness(own[2], es), likeness(own[2], other[2])

    def run(batches):
        held, out, size, place = None, [], 0, None  # held: the last document, until its successor is seen
        for batch in batches:
            for at, look, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != place:
                    held, place = None, at
                text = text or ""
                if look and held is None:
                    continue  # further rows of the successor's doc_id
                own = _prints(text, k, w)
                if held is not None:
                    out.append(row(*held, text, own))
                    size += len(out[-1][3])
                held = None if look else (doc_id, text, own)
                if size > 4 << 20 or len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)

    return run


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, selected hashes and positions (arrays) of every document: the plain operator, without a shuffle."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or "", k, w) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited_likeness(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's."""
    return with_successor(docs, _compare(k, w), _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_likeness(table(spark, sf_dir, "documents"))
