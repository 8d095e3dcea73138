import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import near_dup, neighbours, winnow


def brute_components(rows, width, percent=80):
    """Components by comparing all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def crowd(seed=5):
    """Copies, chains of near copies and a crowd whose members are near its centre only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    centre = [word() for _ in range(120)]
    for share in [0.03] * 40 + [0.09] * 40 + [0.15] * 30:
        add([word() if rng.random() < share / 2 else w for w in centre])
    add(centre)
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain[i * 7 : i * 7 + 3] = [word() for _ in range(3)]
        add(chain)
    for _ in range(60):
        add([word() for _ in range(rng.randint(1, 80))])
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE"), (n + 4, " \t\n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(docs_of, width):
    rows = crowd()
    want = brute_components(rows, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(rows, "1 as rep"), width).collect()}
    assert got == want


def test_components(spark):
    """Stars, chains, cycles and repeated edges in any order give the smallest id of each component."""
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(100, 160)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)] + [(5, 5), (400, 401), (401, 400)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    got = near_dup.components(spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long"))
    assert {r.rep: r.root for r in got.collect()} == want
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(docs_of):
    rows = [(None, "same words here now"), (7, "same words here now"), (4, "x y z"), (4, "p q r"), (8, "p q r"), (None, "nothing like it")]
    got = near_dup.near_duplicates(docs_of(rows), 2).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by == {None: {(7, False), (None, True)}, 7: {(7, True)}, 4: {(4, True)}, 8: {(4, False)}}
    assert near_dup.near_duplicates(docs_of(rows).where("false"), 2).count() == 0
    stay = near_dup.drop_near_duplicates(docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (3, "z")]))
    assert sorted(r.doc_id for r in stay.collect()) == [1, 3] and stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_ids_with_near_texts(docs_of):
    """Sets of one doc_id that share buckets hide no bucket of others."""
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows, groups = [], []
    for g in range(12):
        words = text()
        near = [" ".join(words[:at] + [f"y{g}-{at}"] + words[at + 1 :]) for at in (1, 58)]
        rows += [(10 * g, near[0]), (10 * g, near[1]), (10 * g + 5, " ".join(words)), (10 * g + 5, " ".join(words + ["z"]))]
        groups.append({10 * g, 10 * g + 5})
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(rows), 2).collect()}
    assert got == {d: min(g) for g in groups for d in g}


def test_drop_near_duplicates_without_ids(docs_of):
    """Rows without doc_id are compared like others; different texts of one doc_id are documents of their own."""
    long = [f"w{i}" for i in range(100)]
    near = [" ".join(long[:-1] + [f"x{i}"]) for i in range(4)]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, near[0]), (None, near[1]), (None, near[1]), (None, other), (9, other), (None, " "), (None, None)]
    rows += [(4, "p q r s t u v"), (4, "a b c d e f g"), (4, "a b c d e f g"), (8, "p q r s t u v"), (6, near[2]), (7, near[3])]
    stay = near_dup.drop_near_duplicates(docs_of(rows))
    got = [(r.doc_id, r.text) for r in stay.collect()]
    assert set(got) == {(6, near[2]), (9, other), (None, " "), (None, None), (4, "a b c d e f g"), got[[t for _, t in got].index("p q r s t u v")]}
    assert len(got) == 6 and stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    alone = near_dup.drop_near_duplicates(docs_of(rows[:4])).collect()
    assert len(alone) == 2 and other in {r.text for r in alone}
    found = near_dup.near_duplicates(docs_of(rows[:3] + [(6, near[2])])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, 6, False), (6, 6, True)}


def test_very_long_texts(docs_of):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = words[:200] + ["new"] * 40 + words[240:]
    far = words[:30_000] + [f"v{i}" for i in range(30_000)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + " y")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(rows), 2).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: 4, 5: 5}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [np.sort(pool[:1]), np.sort(pool[:1000]), np.sort(pool[250:1250]), np.sort(pool[:3])]
    s = near_dup.sketch(sets)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[1] == s[2]).mean() - 750 / 1250) < 0.12
    assert (near_dup.sketch(sets[::-1])[::-1] == s).all()


def test_intersections():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for n, n2 in ((1, 1), (30, 50), (70, 70)):
        sides = [[np.unique(np.concatenate([rng.choice(common, 20), rng.integers(0, 300, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(m)] for m in (n, n2)]
        flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x]), len(x)) for x in sides]
        got = near_dup.intersections(*flat[0], *flat[1])
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]


@pytest.mark.parametrize("blocks", [(1024, 1 << 19), (7, 1 << 19), (1024, 1500)])
def test_crowd_at_the_threshold(docs_of, monkeypatch, blocks):
    """A crowd whose pairs lie between 0.6 and 0.9: components as by brute force, and pairs compared in proportion to its size."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", blocks[1])
    made = []
    whole = near_dup.confirmed
    monkeypatch.setattr(near_dup, "confirmed", lambda pairs, *rest: made.append(pairs.count()) or whole(pairs, *rest))
    per = {}
    for n in (150, 600) if blocks[0] == 1024 and blocks[1] > 1500 else (150,):
        rng = random.Random(n)
        centre = [f"c{i}" for i in range(100)]
        rows = []
        for d in range(n):
            words = list(centre)
            for at in rng.sample(range(100), rng.choice([1, 3, 3, 4, 4, 5, 6])):
                words[at] = f"x{d}-{at}"
            rows.append((d, " ".join(words)))
        made.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(rows), 2).collect()}
        assert got == brute_components(rows, 2)
        per[n] = sum(made) / n
    assert max(per.values()) <= 1 + near_dup.HUB_ROUNDS


def test_winnowing():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé ") for _ in range(5000))
    h, p = winnow.fingerprint(text, 8, 10)
    grams = [text[i : i + 8] for i in range(len(text) - 7)]
    value = {g: int(winnow.fingerprint(g, 8, 10)[0][0]) for g in set(grams)}
    want = []
    for i in range(len(grams) - 9):
        window = [value[g] for g in grams[i : i + 10]]
        at = max(j for j in range(10) if window[j] == min(window)) + i
        if not want or want[-1] != at:
            want.append(at)
    assert p.tolist() == want and [int(x) for x in h] == [value[grams[i]] for i in want]
    # A shared passage of W + K - 1 characters is always found.
    passage = text[1000:1017]
    other = "".join(rng.choice("xyz") for _ in range(300)) + passage + "".join(rng.choice("xyz") for _ in range(300))
    assert set(winnow.fingerprint(other, 8, 10)[0].tolist()) & set(h.tolist())
    assert winnow.as_string(*winnow.fingerprint("")) == "" and winnow.likeness(*[np.empty(0, np.uint64)] * 2) == 1.0
    assert len(winnow.fingerprint("ab")[0]) == 1


def test_winnowing_in_blocks(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(40_000))
    whole = winnow.fingerprint(text)
    monkeypatch.setattr(winnow, "_BLOCK", 1000)
    part = winnow.fingerprint(text)
    assert whole[1].tolist() == part[1].tolist() and whole[0].tolist() == part[0].tolist()


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_edited_texts(docs_of, ranges):
    import hashlib

    rng = random.Random(ranges)
    ids = rng.sample(range(-50, 1000), 60)
    rows = [(i, None if i % 9 == 0 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 400)))) for i in ids]
    got = {r.doc_id: r for r in winnow.with_successor(docs_of(rows, "2 as at"), winnow._compare(8, 8), winnow._SCHEMA, ranges).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    assert len(got) == 60
    for (i, t), (_, after) in zip(down, down[1:] + down[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == winnow.as_string(*winnow.fingerprint(edited, 8, 8))
        own = np.unique(winnow.fingerprint(t, 8, 8)[0])
        assert got[i].near_next == winnow.likeness(own, np.unique(winnow.fingerprint(after, 8, 8)[0]))
    assert winnow.edited_likeness(docs_of(rows).where("false")).count() == 0
    assert winnow.edited_likeness(docs_of([(1, "lonely text")])).first().near_next == 1.0
    assert winnow.edited_likeness(docs_of([(1, "a"), (1, "b"), (None, "c")])).count() == 3


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (305, []), (320, [1.0, 2.0]), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(0))
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect()
    y = x.astype(np.float64)
    want = []
    for q in range(0, 300, 20):
        scores = sorted(((-float(sum(a * b for a, b in zip(y[q], y[c]))), c) for c in range(300) if c != q))[:7]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == pytest.approx([w[3] for w in want], rel=1e-12)
    few = neighbours.nearest(frame.where("vec_id < 3"), F.col("vec_id") == 0, 7).collect()
    assert len(few) == 2 and neighbours.nearest(frame.where("false"), F.col("vec_id") == 0, 7).count() == 0


def test_tiles_and_bounds():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(50, 64)), rng.normal(size=(5000, 64))
    a, b, s = neighbours.search_tile(np.arange(50), q, np.arange(5000) + 100, c, 5)
    best = np.argsort(-(q @ c.T), axis=1)[:, :5]
    assert all(set(b[a == i]) == set(best[i]) for i in range(50))
    i8 = rng.integers(-127, 128, (9, 2100)).astype(np.int8)
    assert (neighbours.int8_products(i8, i8) == i8.astype(int) @ i8.astype(int).T).all()
