import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, code, expand, golang, index, metrics, packing, rerank, retrieval
from corvane.plans.samples import GO_SOURCE

DOCS = "doc_id string, path string, text string, lang string"


def chunk_spans(spark, text, most, overlap):
    docs = spark.createDataFrame([("d", "p", text, "text")], DOCS)
    return chunking.line_chunks(docs, most, overlap).orderBy("start_line").collect()


@pytest.mark.parametrize("text, most, overlap", [("\n".join(f"Line {i} of it" for i in range(12)), 10, 2), ("Line one\nLine two\nLine three", 5, 2), ("one two three four five six seven eight", 5, 0), ("only", 50, 10), ("a\n\n\nb\n", 50, 10)])
def test_chunk_invariants(spark, text, most, overlap):
    got, n = chunk_spans(spark, text, most, overlap), text.count("\n") + 1
    covered = {i for c in got for i in range(c.start_line, c.end_line + 1)}
    assert covered == set(range(1, n + 1))
    assert len({c.chunk_id for c in got}) == len(got)
    assert all(b.start_line <= a.end_line + 1 and b.start_line > a.start_line for a, b in zip(got, got[1:]))


def test_chunk_text(spark):
    got = chunk_spans(spark, "\n\nfirst\nlast", 50, 0)
    assert [(c.start_line, c.end_line, c.text) for c in got] == [(1, 4, "first\nlast")]
    assert len(chunk_spans(spark, "", 50, 10)) == 1


def test_suffix_cascade():
    assert chunking.greedy_spans([13] * 100, 512, 50) == [(0, 39), (35, 74), (70, 100), (96, 100), (97, 100), (98, 100), (99, 100)]


def chunks(spark):
    rows = [("c1", "d1", "user authentication login page auth", 1), ("c2", "d1", "database connection pooling database", 2), ("c3", "d2", "token OAuth authentication provider", 1)]
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, start_line int").withColumn("end_line", F.col("start_line")).withColumn("path", F.concat(F.lit("/src/"), "doc_id", F.lit(".go")))
    return chunking.with_tokens(frame)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25(spark):
    got = retrieval.bm25(asked(spark, "authentication", "database", "", "unknownword"), chunks(spark), 10).orderBy("query_id", "rank").collect()
    assert {r.chunk_id for r in got if r.query_id == 0} == {"c1", "c3"}
    assert [r.chunk_id for r in got if r.query_id == 1] == ["c2"] and {r.query_id for r in got} == {0, 1}
    avg = (5 + 4 + 4) / 3
    want = math.log((3 - 1 + 0.5) / 1.5 + 1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / avg))
    assert [r.score for r in got if r.query_id == 1] == [pytest.approx(want)]


def test_bm25_stored_postings_and_path(spark):
    c = chunks(spark)
    plain = retrieval.bm25(asked(spark, "database d1"), c, 5, path_weight=0.5).collect()
    stored = retrieval.bm25(asked(spark, "database d1"), c, 5, path_weight=0.5, posted=index.postings(c)).collect()
    assert plain == stored
    bare = retrieval.bm25(asked(spark, "database d1"), c, 5).first().score
    assert plain[0].score == pytest.approx(bare * (1 + 0.5 * 1 / 2))


def test_vector_search(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.chunk_id, round(r.score, 3)) for r in retrieval.vector_top(q, vectors, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.6)]
    bad = spark.createDataFrame([(0, [1.0])], "query_id long, vector array<float>")
    with pytest.raises(Exception, match="dimension"):
        retrieval.vector_top(bad, vectors, 2).collect()
    known = spark.createDataFrame([("b",)], "chunk_id string")
    assert [r.chunk_id for r in retrieval.semantic(q, vectors, known, 2).collect()] == ["b"]


def test_hybrid(spark):
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(0, "authentication", [1.0, 0.0]), (1, "nothing", [0.0, 1.0])], "query_id long, text string, vector array<float>")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.hybrid(q, chunks(spark), vectors, 5).collect()}
    assert got[(1, "c2")] == 1.0 and got[(0, "c1")] >= 0.5 and got[(0, "c3")] <= 0.5


def test_hybrid_without_embedding(spark):
    """A query whose embedding failed keeps its BM25 results and scores."""
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(0, "authentication", None), (1, "authentication", [1.0, 0.0]), (2, "nothing", None)], "query_id long, text string, vector array<float>")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.hybrid(q, chunks(spark), vectors, 5).collect()}
    plain = {r.chunk_id: r.score for r in retrieval.bm25(asked(spark, "authentication"), chunks(spark), 5).collect()}
    assert {c: s for (i, c), s in got.items() if i == 0} == plain and got[(1, "c1")] != plain["c1"] and not [i for i, _ in got if i == 2]


def test_vectors_of_many_queries(spark, monkeypatch):
    """In tiles the result is that of the join with broadcast queries."""
    rng = random.Random(5)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    vectors = spark.createDataFrame([(f"v{i:03}", vector()) for i in range(90)] + [("z", [0.0] * 6)], "id string, vector array<double>")
    q = spark.createDataFrame([(i, vector()) for i in range(40)] + [(99, [0.0] * 6)], "query_id long, vector array<double>")
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = show(retrieval.vector_top(q, vectors, 7))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    monkeypatch.setattr(retrieval, "TILE", 16)
    assert show(retrieval.vector_top(q, vectors, 7)) == want
    assert retrieval.vector_top(q, vectors.where("false"), 7).count() == 0
    with pytest.raises(Exception, match="dimension"):
        retrieval.vector_top(q, spark.createDataFrame([("a", [1.0])], "id string, vector array<double>"), 2).collect()


def test_bm25_keeps_columns(spark):
    got = retrieval.bm25(asked(spark, "database", "authentication"), chunks(spark), 5, keep=("doc_id", "start_line")).collect()
    assert {(r.chunk_id, r.doc_id, r.start_line) for r in got} == {("c1", "d1", 1), ("c2", "d1", 2), ("c3", "d2", 1)}
    assert retrieval.bm25(asked(spark, "database"), chunks(spark).where("false"), 5).count() == 0


def test_hyde_and_fusion(spark):
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "id string, vector array<float>")
    q = asked(spark, "x")

    def fails(_):
        raise RuntimeError

    embed = lambda texts: [[0.0, 1.0] if t == "x" else [1.0, 0.0] for t in texts]
    assert retrieval.hyde(q, lambda p: "written", embed, vectors, chunks(spark), 1).first().chunk_id == "c1"
    assert retrieval.hyde(q, fails, embed, vectors, chunks(spark), 1, fallback=True).first().chunk_id == "c2"
    r = retrieval.bm25(asked(spark, "authentication"), chunks(spark), 5)
    assert retrieval.reciprocal_ranks(r, r).orderBy(F.desc("score")).first().score == pytest.approx(2 / 61)


def test_jaccard(spark):
    rows = [(["a", "b"], ["a", "b"], 1.0), (["a"], ["b"], 0.0), (["a", "b"], ["b", "c"], 1 / 3), (["a"], [], 0.0), ([], [], 1.0)]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>, want double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in frame.select(rerank.jaccard("a", "b"), "want").collect())


def slow_mmr(scores, tokens, k, trade, dedup):
    top, chosen = max(scores) if max(scores) > 0 else 1, []
    jac = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    while len(chosen) < k:
        best = None
        for i in range(len(scores)):
            if i in chosen:
                continue
            near = max([jac(tokens[i], tokens[j]) for j in chosen], default=0)
            value = trade * scores[i] / top - (1 - trade) * near
            if near <= dedup and (best is None or value > best[0]):
                best = (value, i)
        if best is None:
            break
        chosen.append(best[1])
    return chosen


def test_mmr_against_plain_model():
    rng = random.Random(3)
    for _ in range(30):
        tokens = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(12)]
        scores = sorted((rng.random() for _ in range(12)), reverse=True)
        assert rerank.select_diverse(scores, tokens, 6, 0.6, 0.7) == slow_mmr(scores, tokens, 6, 0.6, 0.7)
    assert rerank.select_diverse([1.0, 0.9], [["a"], ["a"]], 2, 0.5, 0.3) == [0]


def test_rerankers(spark):
    c = chunks(spark)
    found = retrieval.bm25(asked(spark, "authentication provider"), c, 5).join(c.select("chunk_id", "text"), "chunk_id")
    assert rerank.rerank(found, asked(spark, "authentication provider"), 1).first().chunk_id == "c3"
    by_length = rerank.rerank(found, asked(spark, "authentication provider"), 2, scorer=lambda q, ts: [len(t) for t in ts])
    assert by_length.orderBy("rank").first().chunk_id == "c1"


def packable(spark, rows):
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, start_line int, end_line int, text string, score double")
    return frame.withColumns({"query_id": F.lit(0).cast("long"), "mod_time": F.current_timestamp()})


def test_packing(spark):
    docs = spark.createDataFrame([("d", "/p.txt", "", "text")], DOCS)
    rows = [("a", "d", 1, 10, "one two three four five", 1.0), ("b", "d", 11, 20, "six seven", 0.8), ("c", "d", 50, 60, "eight nine ten", 0.6)]
    got = packing.packed_context(asked(spark, "q", "none"), packable(spark, rows), docs, 1000).orderBy("query_id").collect()
    assert [s["range"] for s in got[0].snippets] == ["L1-20", "L50-60"] and got[0].snippets[0].why == "BM25 score: 1.00"
    assert (got[1].used_tokens, got[1].snippets, got[1].budget_tokens) == (0, [], 1000)
    small = packing.packed_context(asked(spark, "q"), packable(spark, rows), docs, 5).first()
    assert small.used_tokens <= 5 and [s["range"] for s in small.snippets] == ["L50-60"] or small.snippets[0]["range"] == "L11-20"
    tight = packing.greedy(packing.utility(packable(spark, [("l", "d", 1, 100, "w " * 50, 1.0), ("s", "d", 200, 210, "two words", 0.9)])), 10)
    assert [r.chunk_id for r in tight.collect()] == ["s"]
    assert "q" in packing.prompts(packing.packed_context(asked(spark, "q"), packable(spark, rows), docs, 50), "builder").first().prompt


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "x", 1)], "query_id long, item string, rank int")
    judged = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (0, "d", 0)], "query_id long, item string, gain int")
    got = {r.query_id: r for r in metrics.evaluate(ranked, judged, 3).collect()}
    assert (got[0].precision, got[0].recall, got[0].reciprocal_rank) == (1.0, 1.0, 1.0) and got[0].ndcg == pytest.approx(0.790, abs=0.01)
    assert (got[1].precision, got[1].reciprocal_rank, got[1].ndcg) == (0.0, 0.0, 0.0)


def test_expansion(spark):
    got = expand.keywords(asked(spark, "DB error")).orderBy("variant").collect()
    assert [r.text for r in got] == ["DB error", "database error", "storage error", "persistence error", "db erroror"]
    assert expand.generated("q", lambda p: "1. first\n- no\nhas: colon\n\nsecond\nq") == ["q", "first", "second"]
    assert expand.generated("q", None) == ["q"]
    docs = spark.createDataFrame([("d", "/p", "1\n2\n3\n4\n5", "text")], DOCS)
    hits = spark.createDataFrame([("d", 3, 3)], "doc_id string, start_line int, end_line int")
    assert expand.around(hits, docs, 1).first().text == "2\n3\n4"
    lines = spark.createDataFrame([("p", 1)], "name string, line int")
    assert expand.around_line(lines, docs, 1).first().text == "1\n2"


def test_related_and_imported(spark):
    docs = spark.createDataFrame([("a", "/x/user.go", "", "go"), ("b", "/x/user_test.go", "", "go"), ("c", "/y/other.py", "", "python"), ("e", "/lib/shop/cart", "", "go")], DOCS)
    cs = spark.createDataFrame([("a1", "a", 1, 'import (\n"fmt"\n"shop/cart"\n)'), ("b1", "b", 1, ""), ("c1", "c", 1, ""), ("e1", "e", 1, "")], "chunk_id string, doc_id string, start_line int, text string")
    hits = spark.createDataFrame([(1, "a1", "a", 2.0, 'import (\n"fmt"\n"shop/cart"\n)')], "rank int, chunk_id string, doc_id string, score double, text string")
    got = expand.related(hits, cs, docs).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("b1", 1.0)]
    assert [(r.chunk_id, r.score) for r in expand.imported(hits, cs, docs).collect()] == [("e1", 0.3)]


def test_golang():
    f = golang.parse(GO_SOURCE)
    by = {u.name: u for u in f.units}
    assert by["Add"].type == "method" and by["Add"].signature == "func (b *Basket) Add(item Item, n int) (total int, err error)"
    assert by["Add"].calls == ["fmt.Errorf", "append", "b.Total"] and by["Add"].doc == "Add puts an item into the basket.\n"
    assert by["Total"].calls == ["price", "log"]
    assert [c["name"] for c in by["Item"].children] == ["Name", "Price", "cart.Entry"]
    assert [(c["type"], c["name"]) for c in by["Store"].children] == [("method", "Put"), ("method", "All"), ("embedded", "fmt.Stringer")]
    assert by["imports"].imports == ["fmt", "strings", "example.org/shop/cart"] and by["first, second, names"].type == "var"
    assert ("*Basket.Total", "method", by["Total"].start_line, "func (*Basket) Total() int") in f.symbols
    assert not any(c[2] == "log" for c in f.calls if c[0] == "*Basket.Total")
    assert golang.parse("not go") is None and golang.parse("package x\nfunc (") is None and golang.parse("package x\n").units == []


def test_split_unit():
    source = "package x\nfunc Big() {\n" + "\n".join(f"call{i}(one, two, three)" for i in range(60)) + "\n}\n"
    unit = golang.parse(source).units[0]
    parts = golang.split_unit(unit, 100, 0)
    assert len(parts) > 1 and all(p["text"].startswith("func Big() {\n") for p in parts)
    assert parts[0]["text"].endswith("// ... continued") and parts[-1]["text"].endswith("}")
    assert parts[0]["suffix"] == "_0" and parts[-1]["end_line"] == unit.end_line


def test_code_analysis(spark):
    docs = spark.createDataFrame([("d", "/a.py", 'def f(x):\nclass A(B):\n# one\n# two\n# TODO: x\n"""doc\nmore"""\n', "python"), ("g", "/s.go", GO_SOURCE, "go")], DOCS)
    assert [(r.name, r.type, r.line) for r in code.prefix_symbols(docs).orderBy("line").collect()] == [("f", "function", 1), ("A", "class", 2)]
    got = [(r.type, r.text, r.start_line, r.end_line) for r in code.comments(docs.where("doc_id = 'd'")).orderBy("start_line").collect()]
    assert got == [("line", "one\ntwo", 3, 4), ("doc", "# TODO: x", 5, 5), ("block", '"""doc\nmore"""', 6, 7)]
    symbols = golang.symbols(docs)
    calls = code.resolve_calls(golang.calls(docs), symbols)
    price = symbols.where("name = 'price'").select("id")
    assert [r.name for r in code.callers(calls, symbols, price).collect()] == ["*Basket.Total"]
    cs = chunking.composite_chunks(docs.where("lang = 'go'"))
    meta = {r.name: r for r in code.chunk_metadata(cs, symbols, calls).collect() if r.name}
    assert meta["price"].type == "function" and len(meta["price"].called_by) == 1
    assert code.comment_tokens(docs.where("doc_id = 'd'")).where("term = 'one'").first().n == 1


def test_incremental(spark):
    t = F.to_timestamp(F.lit("2024-01-01"))
    old = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "path string, d int").select("path", t.alias("mod_time"))
    new = spark.createDataFrame([("a", 0), ("b", 1), ("n", 0)], "path string, d int").select("path", F.when(F.col("d") == 1, t + F.expr("INTERVAL 1 DAY")).otherwise(t).alias("mod_time"))
    assert {r.path: r.status for r in index.incremental_diff(old, new).collect()} == {"a": "skip", "b": "update", "c": "delete", "n": "insert"}
