"""Near-duplicate groups by fast similarity sketching.

A document is the set of its distinct word shingles.  The sketch of Dahlgaard,
Knudsen and Thorup ("Fast similarity sketching", 2017) throws the whole set
into ``COORDINATES`` bins in rounds: in the first rounds a hash chooses each
element's bin, in the later ones every element goes to the one bin whose turn
it is, so that no coordinate stays empty after twice as many rounds; a bin
keeps the smallest (round, hash) it has seen.  Two sketches agree in a
coordinate with the similarity of the sets as probability, and the number of
agreements is concentrated as for independent samples.  ``ROWS`` coordinates
make a band.  At a similarity of 0.8 a pair misses all 56 bands with
probability (1 - 0.8**6)**56 < 5e-8; at 0.05 it meets one with 9e-7.

Documents with the same set are one node from the start.  Buckets that hold the
same members count as one, of their number as weight.  Then every node is
compared on the full sets with one other, the smallest member of the buckets it
shares most with it, and the links are joined to components.  In a bucket that
still holds several components, ``HUB_ROUNDS`` rounds compare every node outside
the largest one with one member of it, again one pair a node.  What is left
apart is settled in tiles: blocks of the outsiders against each other and
against the largest component, bounded by members and by shingles, which carry
the full sets, count all intersections exactly and give back only a spanning
forest of the links they find.  So no bucket is capped, no step makes more pairs
than it has nodes, and any two nodes that share a bucket are connected, or
refuted by their full sets.  The tiles of a crowd in which no member is near
another still do work with the square of its size: that is the price of losing
no link; it is spread over as many tasks as there are tiles.  Sets are built
again for the documents that need it, from their texts, rather than shuffled
for all.

Defined results: a null text is an empty one; an empty document has no
shingles and is linked with nothing; rows that repeat a doc_id are one document
when linking; rows without doc_id are linked like others, those of one text as
one document, and a component_id is null unless a doc_id is in the component
(doc_ids are taken to be below 2**62); other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import Memo, discard, texts, tune, written

ROWS, BANDS = 6, 56
COORDINATES = ROWS * BANDS
#: Up to this many doc_ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Rounds that compare outsiders with a member of their bucket's largest component, before tiles.
HUB_ROUNDS = 2
#: Most members and most shingles of a block, two of which meet in a tile (on average, as blocks are drawn by hash).
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 19
#: Keys from here on are names made from hashes, above all real doc_ids.
NAMES = 1 << 62
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_words(words: list[bytes]) -> list[int]:
    import xxhash

    return list(map(xxhash.xxh3_64_intdigest, words))


@functools.lru_cache(maxsize=1)
def _memo() -> Memo:
    return Memo(_hash_words, 300_000, "shingles")


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct ``width``-word shingles.

    ASCII capitals are lower-cased, words are runs of anything but space, tab,
    line feed, vertical tab, form feed and carriage return.
    """
    cut = [t.encode().lower().split() if t else [] for t in texts]
    memo = _memo()
    memo.fill(*cut)
    get, out = memo.__getitem__, []
    for words in cut:
        h = np.fromiter(map(get, words), np.uint64, len(words))
        n = len(h)
        take = min(width, n)
        x = np.full(max(0, n - take + 1) if n else 0, np.uint64(0x51ED270B + take))
        for i in range(take):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - take + 1 + i])
        x.sort()
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return out


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """The sketch matrix, one row of t coordinates for each (non-empty) set."""
    out = np.full((len(sets), t), _MAX, np.uint64)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return out
    elements = np.concatenate([sets[i] for i in live])
    sizes = np.array([len(sets[i]) for i in live], np.int64)
    state = out[live]
    owner = np.repeat(np.arange(len(live)), sizes)
    for turn in range(2 * t):
        v = _mix(elements + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        value = (v & np.uint64((1 << 40) - 1)) | np.uint64(turn << 40)
        if turn < t:
            place = ((v >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            place = turn - t
        np.minimum.at(state.reshape(-1), owner * t + place, value)
        if turn % 4 == 3 or turn < 2 or len(live) > 200:
            open_ = (state == _MAX).any(axis=1)
            if not open_.all():
                out[live[~open_]] = state[~open_]
                if not open_.any():
                    return out
                kept = open_[owner]
                elements, owner = elements[kept], (np.cumsum(open_) - 1)[owner[kept]]
                live, state = live[open_], state[open_]
    out[live] = state
    return out


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, t = sketches.shape
    bands = sketches.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                keys = band_keys(sketch(sets))
                bands = [k if len(s) else [] for s, k in zip(sets, keys, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def semi_join(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) their key in the written table ``ids``, which is broadcast only if it is small."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def _name(*columns: str) -> Column:
    """A key made from columns."""
    return F.lit(NAMES) + F.xxhash64(*columns).bitwiseAND(NAMES - 1)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, by columns rep and hub, whose full sets have 100 * intersection >= percent * union."""
    size = lambda c: F.size(c).cast("long")
    near = pairs.join(sets.select(F.col("id").alias("rep"), F.col("shingles").alias("s")), "rep").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("t")), "hub")
    # The smaller set must reach percent of the larger one; that needs no intersection.
    near = near.where(100 * F.least(size("s"), size("t")) >= percent * F.greatest(size("s"), size("t")))
    near = near.select(*pairs.columns, (size("s") + size("t")).alias("total"), size(F.array_intersect("s", "t")).alias("both"))
    return near.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select(pairs.columns)


def hubs(crowds: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold several components: ``crowds`` with root, the bucket's largest component (main), one of its members (hub), and the blocks of the rest (outer) and of it (inner).

    The hub is drawn by a hash of the node, so that the buckets of one crowd agree on it.
    """
    placed = crowds.join(found, "rep", "left").select("band", "weight", "rep", "size", F.coalesce("root", "rep").alias("root"))
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep"))["rep"].alias("hub"))
    whole = parts.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", -F.col("root"), "root", "size", "hub")).alias("top"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    outer, inner = blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")), blocks(F.col("top.n"), F.col("top.size"))
    whole = whole.where("roots > 1").select("band", F.col("top.root").alias("main"), F.col("top.hub").alias("hub"), outer.alias("outer"), inner.alias("inner"))
    return placed.join(whole, "band")


def one_each(members: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """One pair (rep, hub; root, main) for each outsider: the hub it shares most buckets with, of those it was not yet compared with."""
    shared = members.where("root != main").groupBy("rep", "root", "main", "hub").agg(F.sum("weight").alias("shared"))
    if tried is not None:
        turned = tried.select(F.col("rep").alias("hub"), F.col("hub").alias("rep"))
        shared = shared.join(tried.select("rep", "hub").unionByName(turned), ["rep", "hub"], "left_anti")
    best = shared.groupBy("rep").agg(F.max(F.struct("shared", "hub", "root", "main")).alias("best"))
    return best.select("rep", "best.hub", "best.root", "best.main")


def intersections(values: np.ndarray, owner: np.ndarray, n: int, values2: np.ndarray, owner2: np.ndarray, n2: int) -> np.ndarray:
    """The n x n2 matrix of intersection sizes of sets given as elements with their owners.

    Elements that many sets of both sides hold are multiplied as dense columns, all others are listed pair by pair.
    """
    known, at = np.unique(np.concatenate([values, values2]), return_inverse=True)
    at, at2 = at[: len(values)], at[len(values) :]
    held, held2 = np.bincount(at, minlength=len(known)), np.bincount(at2, minlength=len(known))
    out = np.zeros((n, n2))
    dense = held * held2 >= max(1, n * n2 // 32)
    columns = np.flatnonzero(dense)
    place = np.full(len(known), -1)
    for first in range(0, len(columns), 1024):
        some = columns[first : first + 1024]
        place[some] = np.arange(len(some))
        a, b = np.zeros((n, len(some)), np.float32), np.zeros((n2, len(some)), np.float32)
        for m, who, where in ((a, owner, at), (b, owner2, at2)):
            kept = place[where] >= 0
            m[who[kept], place[where[kept]]] = 1
        out += a @ b.T
        place[some] = -1
    # The rest: each element of the first side meets all holders of it on the second one.
    kept = ~dense[at] & (held2[at] > 0)
    left, left_owner = at[kept], owner[kept]
    order = np.argsort(at2, kind="stable")
    start, holders = np.concatenate([[0], np.cumsum(held2)]), owner2[order]
    times = held2[left]
    ends = np.cumsum(times)
    flat = out.reshape(-1)
    first = 0
    while first < len(left):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 21), "right")))
        t = times[first:last]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        met = np.repeat(left_owner[first:last], t) * n2 + holders[np.repeat(start[left[first:last]], t) + step]
        cells, count = np.unique(met, return_counts=True)
        flat[cells] += count
        first = last
    return out


def _joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' components under the edges x, y."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[x], low[y])
        now = low.copy()
        np.minimum.at(now, x, m)
        np.minimum.at(now, y, m)
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _forest(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Roots (a) that links of this tile join to a smaller root (b)."""
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        root, block = (group.column(c).to_numpy() for c in ("root", "block"))
        inside = group.column("inside").to_numpy()
        lists = group.column("shingles").combine_chunks()
        values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
        sizes = np.diff(np.concatenate([[0], ends]))
        owner = np.repeat(np.arange(len(root)), sizes)
        first = ~inside & (block == i)
        second = first if i == j else ~first
        u, v = np.flatnonzero(first), np.flatnonzero(second)
        none = pa.table([np.empty(0, np.int64)] * 2, names=["a", "b"])
        if not len(u) or not len(v):
            return none
        number = np.zeros(len(root), np.int64)
        number[u] = np.arange(len(u))
        a, a_owner = values[first[owner]], number[owner[first[owner]]]
        number[v] = np.arange(len(v))
        both = intersections(a, a_owner, len(u), values[second[owner]], number[owner[second[owner]]], len(v)).astype(np.int64)
        near = 100 * both >= percent * (sizes[u][:, None] + sizes[v] - both)
        near &= root[u][:, None] != root[v]
        x, y = np.nonzero(near)
        known, at = np.unique(root, return_inverse=True)
        edges = np.unique(at[u[x]] * len(known) + at[v[y]])
        low = _joined(edges // len(known), edges % len(known), len(known))
        moved = np.flatnonzero(low != np.arange(len(known)))
        return pa.table([known[moved], known[low[moved]]], names=["a", "b"]) if len(moved) else none

    return run


def tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the components in the buckets of ``hubs`` members, whose full sets meet in tiles of two blocks."""
    inside = F.col("root") == F.col("main")
    rows = members.withColumn("inside", inside).withColumn("block", F.pmod(F.xxhash64("rep"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # Tiles are (i, j) for two blocks of outsiders, i <= j, and (i, -1 - j) for outsiders and the largest component.
    tile = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outside = F.concat(F.transform(count("outer"), lambda k: tile(F.least("block", k), F.greatest("block", k))), F.transform(count("inner"), lambda k: tile(F.col("block"), -1 - k)))
    tiles = F.when(inside, F.transform(count("outer"), lambda k: tile(k, -1 - F.col("block")))).otherwise(outside)
    rows = rows.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select("band", "root", "inside", "block", "shingles", F.explode(tiles).alias("tile"))
    rows = rows.select("band", "tile.i", "tile.j", "root", "inside", "block", "shingles")
    return rows.groupBy("band", "i", "j").applyInArrow(_forest(percent), "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end (a) has one edge, to a node (b) that is no larger end itself."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return several.union(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id of its component, for every end of an edge but the smallest ones.

    Alternates the large-star and small-star steps of Kiveris et al.; both are
    a minimum for each node and a join back, written down each time, until only
    stars are left.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = written(small.where("a != b").distinct(), "cc")
        discard(edges, large)
        edges = small
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("root"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` components (rep, root) after the edges ``more`` (a, b) between roots."""
    roots = components(more)
    higher = roots.select(F.col("rep").alias("root"), F.col("root").alias("top"))
    moved = found.join(higher, "root", "left").select("rep", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(roots), "near-found")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every document."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A row without doc_id is named by its text.
    docs = docs.withColumn("key", F.coalesce("doc_id", _name("text")))
    signed = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sign(width), "doc_id long, key long, row long, n_shingles long, digest binary, bands array<long>")
    signed = written(signed, "near-signed")
    filled, named = signed.where("n_shingles > 0"), not signed.where(F.col("key") >= NAMES).isEmpty()
    # One row of each set, that of the smallest key, stands for all.
    reps = written(filled.groupBy("digest").agg(F.min(F.struct("key", "row")).alias("rep")).select("digest", "rep.key", "rep.row"), "near-reps")
    nodes = written(filled.select("doc_id", "key", "n_shingles", "digest").join(reps.select("digest", F.col("key").alias("rep")), "digest").select("doc_id", "key", "n_shingles", "rep"), "near-nodes")
    empty = written(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"), F.lit(None).cast("long").alias("key")), "near-empty")
    banded = written(filled.join(reps.select("row").hint("merge"), "row", "left_semi").select("row", F.col("key").alias("rep"), F.col("n_shingles").alias("size"), "bands"), "near-bands")
    discard(signed, reps)

    banded = banded.select("row", "rep", "size", F.explode("bands").alias("band"))
    # Rows tell the sets of a repeated doc_id apart, so that none cancels another out.
    met = banded.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("members"))
    met = met.where("n > 1").groupBy("low", "n", "members").agg(F.min("band").alias("band"), F.count("*").alias("weight"))
    crowds = written(banded.drop("row").join(met.select("band", "weight", "low"), "band"), "near-crowds")
    # These sets serve all that follows.
    ids = written(crowds.select(F.col("rep").alias("key")).distinct(), "near-ids")
    texts = semi_join(docs, ids, "left_semi").select("key", "text")
    if named:  # one row is enough of those that share a name
        texts = texts.where(F.col("key") < NAMES).union(texts.where(F.col("key") >= NAMES).dropDuplicates(["key"]))
    sets = written(texts.mapInArrow(_sets(width), "id long, shingles array<long>"), "near-sets")

    members = crowds.withColumns({"root": F.col("rep"), "main": F.col("low"), "hub": F.col("low")})
    tried = written(one_each(members), "near-tried")
    links = confirmed(tried, sets, percent).select(F.col("root").alias("a"), F.col("main").alias("b"))
    # Rows of one doc_id with different sets are one document.
    ways = nodes.select("key", "rep").distinct()
    several = ways.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    same = ways.join(several, "key").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(same))

    for turn in range(1, HUB_ROUNDS + 2):
        members = written(hubs(crowds, found, turn), "near-members")
        discard(crowds)
        if members.isEmpty():
            break
        crowds = members.select("band", "weight", "rep", "size")
        crowds.scratch_path = members.scratch_path
        if turn <= HUB_ROUNDS:
            fresh = written(one_each(members, tried), "near-tried")
            if fresh.isEmpty():
                continue
            more = confirmed(fresh, sets, percent).select(F.col("root").alias("a"), F.col("main").alias("b"))
            tried = tried.unionByName(fresh)
        else:
            more = tiled(members, sets, percent)
        found = merged(found, more)
    discard(crowds, sets, ids)

    whole = nodes.join(found, "rep", "left").withColumn("component", F.coalesce("root", "rep"))
    whole = whole.select("doc_id", "n_shingles", "component", "key").union(empty)
    name = F.when(F.col("component") < NAMES, F.col("component"))  # a name made from a text is no doc_id
    return whole.select("doc_id", "n_shingles", name.alias("component_id"), (F.col("key").isNull() | (F.col("key") == F.col("component"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that of the smallest doc_id, whole and with all columns.

    Here every text is a document of its own, whether its doc_id is null or
    repeated; rows that share both doc_id and text are one, and rows without
    doc_id and words all stay. Of a group of rows with null doc_ids or further
    texts of a repeated one alone, any one stays; other rows go before them.
    """
    rows = docs.withColumn("near_id", F.col("doc_id").cast("long"))
    said = F.xxhash64(F.col("text").cast("string"))
    # Of a doc_id's different texts one keeps the doc_id as its key, the others are named.
    ways = written(rows.where("near_id is not null").groupBy("near_id").agg(F.min(said).alias("near_low"), F.max(said).alias("high")).where("near_low != high").drop("high"), "near-ways")
    n = ways.count()
    rows = rows.join(F.broadcast(ways) if n <= BROADCAST_IDS else ways, "near_id", "left") if n else rows.withColumn("near_low", F.lit(None).cast("long"))
    own = F.col("near_id").isNotNull() & (F.col("near_low").isNull() | (F.col("near_low") == said))
    rows = rows.withColumn("near_key", F.when(own, F.col("near_id")).otherwise(_name("near_id", "text"))).drop("near_id", "near_low")
    found = near_duplicates(rows.select(F.col("near_key").alias("doc_id"), "text"), width, percent)
    found = written(found.select(F.col("doc_id").alias("near_key"), "n_shingles", "kept"), "near-found")
    stay = semi_join(rows, written(found.where("not kept").select("near_key").distinct(), "near-gone"), "left_anti")
    again = found.where((F.col("n_shingles") > 0) | (F.col("near_key") < NAMES)).groupBy("near_key").count().where("count > 1").select("near_key")
    again = written(again, "near-again")
    if not again.isEmpty():
        stay = semi_join(stay, again, "left_anti").unionByName(semi_join(stay, again, "left_semi").dropDuplicates(["near_key"]))
    return stay.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 80 % of their two-word shingles."""
    return near_duplicates(texts(spark, sf_dir, "documents"), width=2)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), items AS (
  SELECT rep, len(s) AS n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT d.doc_id, c.rep FROM sets d JOIN classes c ON list_sort(d.s) = list_sort(c.s)
  UNION SELECT c.rep, d.doc_id FROM sets d JOIN classes c ON list_sort(d.s) = list_sort(c.s)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r
)
SELECT d.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
FROM documents d JOIN sets s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, s.s
"""
