import json

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.config import Config, IndexConfig, overlay, parse_settings
from corvane.functions import text as tx
from corvane.plans import facade, ports
from corvane.plans.agent import Agent, decide, variants
from corvane.plans.cache import QueryCache
from corvane.plans.engine import Engine
from corvane.plans.samples import GO_SOURCE
from corvane.sources import corpus, files, store
from corvane.streaming import incremental

PAGES = {"/a/auth.txt": "user authentication and login page\nsession tokens", "/a/db.txt": "database connection pooling\nqueries and transactions", "/a/auth_notes.txt": "notes on authentication"}


def test_config(tmp_path):
    assert Config.find(tmp_path) == Config() and Config().index.chunk_tokens == 512 and Config().pack.token_budget == 4000
    (tmp_path / "rag.yaml").write_text("index:\n  chunk_tokens: 256  # less\n  stemming: false\n  includes:\n    - \"**/*.py\"\nretrieve:\n  top_k: 10\npack:\n  token_budget: 8000\nodd: 1\n")
    got = Config.find(tmp_path)
    assert (got.index.chunk_tokens, got.index.stemming, got.index.includes, got.retrieve.top_k, got.pack.token_budget) == (256, False, ("**/*.py",), 10, 8000)
    got.save(tmp_path / "again.yaml")
    assert Config.load(tmp_path / "again.yaml") == got
    assert got.index_hash() != Config().index_hash() and overlay(Config(), {}) == Config()
    assert parse_settings('{"a": [1]}') == {"a": [1]}


@pytest.mark.parametrize("pattern, path, fits", [("**/*.go", "a/b/c.go", True), ("**/*.go", "c.go", True), ("*.go", "a/c.go", False), ("**/vendor/**", "x/vendor/y.go", True), ("**/*", "a", True), ("a/**", "a/b/c", True), ("{a,b}/?.txt", "b/x.txt", True), ("[!a]x", "ax", False), ("[", "[", False)])
def test_globs(spark, pattern, path, fits):
    row = spark.createDataFrame([(path,)], "p string")
    assert row.select(files.matches(F.col("p"), [pattern])).first()[0] is fits


def test_walk(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "vendor/c.py", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    got = files.read_documents(spark, str(tmp_path), ["**/*.py"], ["**/vendor/**"])
    assert {r.path.rsplit("/", 1)[-1]: (r.text, r.lang) for r in got.collect()} == {"a.py": ("# a.py", "python"), "b.py": ("# sub/b.py", "python")}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    config = overlay(Config(), {"embedding": {"enabled": True, "dimension": 16}, "index": {"chunk_tokens": 8, "chunk_overlap": 0}})
    made = Engine(spark, str(tmp_path_factory.mktemp("index")), config)
    first = made.index_memory(PAGES)
    assert (first.indexed, first.skipped, first.deleted) == (3, 0, 0)
    return made


def test_engine_answers(engine):
    got = engine.query("authentication", 5)
    assert {r.path for r in got} == {"/a/auth.txt", "/a/auth_notes.txt"} and engine.query("authentication", 5) is got
    assert [r.path for r in engine.query("databases", 3, diverse=False)] == ["/a/db.txt"]
    wide = engine.query("pooling", 1, context=5)
    assert wide[0].text == PAGES["/a/db.txt"]
    assert engine.stats()["total_docs"] == 3
    packed = engine.pack(engine.queries("authentication", "nothing")).orderBy("query_id").collect()
    assert packed[0].used_tokens > 0 and packed[1].snippets == []
    assert "authentication" in engine.prompt("authentication") and json.loads(engine.result_json("authentication"))[0]["rank"] == 1
    hybrid = engine.retrieve(engine.queries("authentication"), 3, "hybrid").collect()
    semantic = engine.retrieve(engine.queries("authentication"), 3, "semantic", diverse=False).collect()
    assert hybrid and len(semantic) == 3
    store = engine.store
    chunk = store.read("chunks").first()
    assert store.chunk(chunk.chunk_id).text == chunk.text and store.doc_chunks(chunk.doc_id).count() >= 1
    assert store.term_postings("databas").count() == 1
    with pytest.raises(KeyError):
        store.doc("none")


def test_engine_follows_changes(engine, spark):
    docs = engine.store.read("docs")
    later = docs.withColumn("mod_time", F.col("mod_time") + F.expr("INTERVAL 1 HOUR"))
    snapshot = later.where("path = '/a/db.txt'").withColumn("text", F.lit("quite other words")).unionByName(docs.where("path = '/a/auth.txt'"))
    snapshot = spark.createDataFrame(snapshot.collect(), snapshot.schema)
    assert engine.stale(snapshot).count() == 2
    got = engine.index(snapshot)
    assert (got.indexed, got.skipped, got.deleted) == (1, 1, 1)
    assert engine.query("pooling", 3) == [] and engine.query("words", 3)[0].path == "/a/db.txt"
    ids = {r.chunk_id for r in engine.store.read("chunks").collect()}
    assert {r.id for r in engine.store.read("vectors").collect()} == ids
    assert {r.chunk_id for r in engine.store.read("postings").collect()} <= ids
    with pytest.raises(ValueError):
        engine.store.upsert_vectors(engine.config, spark.createDataFrame([("x", [1.0])], "id string, vector array<float>").withColumn("metadata", F.create_map().cast("map<string,string>")))


def test_store_writes_what_changes(spark, tmp_path, monkeypatch):
    """Changes add small parts; many parts become one; old parts are removed once no reader can hold them."""
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    made = Engine(spark, str(tmp_path / "index"), overlay(Config(), {"index": {"ast_chunking": False}}))
    body = {f"/d{i}.txt": f"words of document {i} number{i}" for i in range(6)}
    made.index_memory(body)
    first = made.store.manifest()["tables"]["chunks"][0][0]
    for turn in range(6):
        name = f"/d{turn}.txt"
        body[name] = f"other words {turn} changed{turn}"
        later = corpus.in_memory(spark, {name: body[name]}).withColumn("mod_time", F.current_timestamp() + F.make_dt_interval(F.lit(turn + 1)))
        made.index(later, whole=False)
        m = made.store.manifest()
        assert len(m["tables"]["chunks"]) <= 3 and m["seq"] == turn + 2
        assert {r.text for r in made.store.read("chunks").collect()} == set(body.values())
        assert made.query(f"changed{turn}", 3)[0].path == name and made.query(f"number{turn}", 3) == []
        terms = {r.term for r in made.store.read("postings").collect()}
        assert f"chang{turn}" not in terms and any(t.startswith("changed") for t in terms)
    folders = {p.name for p in (tmp_path / "index").iterdir() if p.is_dir()}
    assert first not in folders and folders == set(made.store._parts(m)) | set(m["before"])
    made.store.delete_docs(made.config, made.store.read("docs").where("path < '/d4'"))
    assert made.stats()["total_docs"] == 2 and made.store.read("docs").count() == 2
    made.clear()
    assert made.stats()["total_docs"] == 0 and not made.store.has("docs")


def test_lookups(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "index"))
    made.index(spark.createDataFrame([("/a.go", GO_SOURCE)], "path string, text string").withColumns({"doc_id": tx.doc_id("path"), "mod_time": F.current_timestamp(), "lang": F.lit("go")}))
    doc = made.store.read("docs").first().doc_id
    symbols = {r.name: r.id for r in made.store.doc_symbols(doc).collect()}
    assert made.store.symbol(symbols["price"]).type == "function" and symbols["price"] in {r.callee_id for r in made.store.doc_calls(doc).collect()}
    assert made.store.doc_symbols("none").count() == 0
    with pytest.raises(KeyError):
        made.store.symbol("none")


def test_index_on_demand(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "index"))
    docs = corpus.in_memory(spark, PAGES).persist()
    docs.count()
    with pytest.raises(LookupError):
        made.ensure(docs, auto=False)
    with pytest.raises(LookupError):
        made.ensure(docs, ask=lambda question: False)
    assert made.ensure(docs) == [] and made.stats()["total_docs"] == 3
    assert made.ensure(docs, ask=lambda question: pytest.fail("nothing changed")) == []
    later = docs.where("path != '/a/db.txt'").withColumn("mod_time", F.col("mod_time") + F.expr("INTERVAL 1 HOUR"))
    asked = []
    assert made.ensure(later, ask=lambda question: asked.append(question) or False) == ["/a/auth.txt", "/a/auth_notes.txt", "/a/db.txt (deleted)"]
    assert len(asked) == 1 and made.stats()["total_docs"] == 3 and made.ensure(later, auto=False) == []
    made.ensure(later)
    assert made.stats()["total_docs"] == 2


def test_embedding_fails(spark, tmp_path):
    """Hybrid search falls back to BM25, semantic search says so."""
    config = overlay(Config(), {"embedding": {"enabled": True, "dimension": 2}, "index": {"ast_chunking": False}})
    path = str(tmp_path / "index")
    Engine(spark, path, config, lambda texts: [[1.0, 0.0] for _ in texts]).index_memory(PAGES)

    def down(texts):
        raise ConnectionError("no service")

    made = Engine(spark, path, config, down)
    queries = made.queries("authentication")
    show = lambda df: [(r.chunk_id, r.score) for r in df.orderBy("rank").collect()]
    assert show(made.candidates(queries, 5, "hybrid")) == show(made.candidates(queries, 5, "bm25"))
    with pytest.raises(Exception, match="no service"):
        made.candidates(queries, 5, "semantic").collect()


def test_facade_errors(spark, tmp_path):
    made = facade.Facade(spark, str(tmp_path / "index"))
    assert json.loads(made.query("words"))["results"] == [] and json.loads(made.stats())["files"] == []
    assert "error" in json.loads(made.index("a.txt"))
    assert json.loads(made.index("a.txt", "some words"))["success"] and json.loads(made.stats())["totalDocs"] == 1


def test_command_line(spark, tmp_path, capsys):
    for name, text in (("a.py", "def login(user):\n    return session(user)\n"), ("b.md", "how the database pools connections\n")):
        (tmp_path / name).write_text(text)
    run = lambda *args: cli.main(["-d", str(tmp_path), *args])
    assert run("query", "-q", "login", "--no-auto-index") == 1 and "no index" in capsys.readouterr().err
    assert run("query", "-q", "database pools", "--json") == 0
    said = capsys.readouterr()
    assert json.loads(said.out)[0]["path"].endswith("b.md") and "[auto: yes]" in said.err
    assert run("index") == 0 and "skipped 2" in capsys.readouterr().out
    assert run("query", "-q", "login", "--no-mmr", "-c", "1") == 0 and "a.py:L1-" in capsys.readouterr().out
    assert run("query", "-q", "login", "--semantic") == 1
    packed = tmp_path / "ctx.json"
    assert run("pack", "-q", "login", "-b", "100", "-o", str(packed)) == 0 and "Snippets: 1" in capsys.readouterr().out
    assert json.loads(packed.read_text())["budget_tokens"] == 100
    assert run("pack", "-q", "zzunknownzz") == 0 and "No relevant" in capsys.readouterr().err
    assert run("runprompt", "--runtime", "--ctx", str(packed), "-q", "Who logs in?") == 0
    said = capsys.readouterr().out
    assert "Who logs in?" in said and "a.py" in said
    assert run("stats") == 0 and json.loads(capsys.readouterr().out)["total_docs"] == 2
    assert run("clear") == 0 and run("runprompt", "--builder", "--ctx", str(tmp_path / "none")) == 1


def test_agent(engine):
    said = []

    def model(prompt):
        said.append(prompt)
        if "Reply in JSON" in prompt:
            return 'Well: {"sufficient": false, "queries": ["database"], "lines": [{"file": "auth.txt", "line": 1}]}'
        return "- no\n1. login page" if "one a line" in prompt else "the answer"

    agent = Agent(engine, model, k=4, budget=200, expand=True)
    got = agent.run("authentication")
    assert got["answer"] == "the answer" and got["rounds"] == 2 and "=== /a/auth.txt:L1-" in got["context"]
    assert agent.run("authentication", fast=True)["rounds"] == 1
    assert agent.savings("x" * 40, "y" * 8).first().sent_tokens == 10
    assert decide("no json, insufficient").sufficient is False and decide("{bad").sufficient and variants("a\nb: c\n* d") == ["a"]


def test_migration(spark, engine):
    assert engine.store.check(engine.config) == engine.store.check(engine.config)
    assert not engine.store.check(engine.config).needs_rebuild
    other = overlay(engine.config, {"index": {"chunk_tokens": 9}})
    assert engine.store.check(other).needs_rebuild
    manifest = engine.store.manifest()
    engine.store.save_manifest(manifest | {"version": 99})
    assert engine.store.check(engine.config).needs_rebuild
    engine.store.save_manifest(manifest)
    assert overlay(Config(), {"index": {}}).index == IndexConfig()


def test_cache():
    now = [0.0]
    cache = QueryCache(2, 10, lambda: now[0])
    cache.put("a", 1, "A")
    cache.put("b", 1, "B")
    assert cache.get("a", 1) == "A" and cache.get("a", 2) is None
    cache.put("c", 1, "C")
    assert cache.get("b", 1) is None and cache.get("a", 1) == "A"
    now[0] = 11
    assert cache.get("a", 1) is None
    cache.put("d", 1, "D")
    cache.invalidate()
    assert cache.get("d", 1) is None and cache.cached("d", 1, lambda: 5) == 5


def test_ports(spark):
    sent = []

    def post(url, body, key, timeout):
        sent.append((url, body))
        if "documents" in body:
            return {"results": [{"index": 1, "relevance_score": 0.9}]}
        if "messages" in body:
            return {"choices": [{"message": {"content": "said"}}]}
        n = len(body["input"])
        return {"data": [{"index": i, "embedding": [float(len(body["input"][i]))]} for i in reversed(range(n))]}

    embed = ports.http_embedder(overlay(Config(), {"embedding": {"batch_size": 2}}).embedding, post)
    assert embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and len(sent) == 2
    assert ports.http_reranker("http://x", "m", "", post)("q", ["a", "b"]) == [0.0, 0.9]
    chat = ports.Chat("http://x", "m", post=post)
    assert chat("hello there", "sys") == "said" and chat.calls == 1 and chat.tokens_out == 1
    rows = spark.createDataFrame([("c", "four"), ("d", "x")], "chunk_id string, text string")
    known = spark.createDataFrame([("d",)], "id string")
    assert ports.embed_chunks(rows, lambda ts: [[float(len(t))] for t in ts], 1, known).collect() == [("c", [4.0])]


def test_stream(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "index"), overlay(Config(), {"index": {"ast_chunking": False}}))
    rows = spark.createDataFrame([("/a.txt", "first words", 0), ("/b.txt", "second words", 0)], "path string, text string, d int")
    timed = lambda r: r.select("path", "text", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval("d")).alias("mod_time"))
    timed(rows).write.parquet(str(tmp_path / "in"))
    incremental.watch(spark, str(tmp_path / "in"), made, str(tmp_path / "cp")).awaitTermination()
    assert made.stats()["total_docs"] == 2
    timed(rows.where("path = '/a.txt'").withColumns({"text": F.lit("third thing"), "d": F.lit(1)})).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.watch(spark, str(tmp_path / "in"), made, str(tmp_path / "cp")).awaitTermination()
    assert {r.text for r in made.store.read("docs").collect()} == {"third thing", "second words"}
