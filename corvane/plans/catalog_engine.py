"""Queries over the engine, its services and its maintenance, on small stated contents; their oracles state the expected rows."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import SparkSession, functions as F

from corvane.config import Config, overlay, parse_settings, to_yaml
from corvane.functions import text as tx
from corvane.plans import ports
from corvane.plans.agent import Agent
from corvane.plans.cache import QueryCache
from corvane.plans.catalog import entry
from corvane.plans.catalog_code import _CALLS, _GO_DOC, _SYMBOLS, _callee, _id, _symbol, _values
from corvane.plans.engine import Engine
from corvane.plans.samples import GO_SOURCE, SOURCES
from corvane.sources import corpus, files
from corvane.sources.store import scratch

LINES = {"index": {"ast_chunking": False, "stemming": False}}
NAMED = {"auth.txt": "how sessions are closed\nand opened again", "db.txt": "rows and tables", "old.txt": "sessions"}


def _engine(spark: SparkSession, contents: dict[str, str], settings: dict | None = None) -> Engine:
    engine = Engine(spark, scratch(spark, "small"), overlay(Config(), settings or LINES))
    engine.index_memory(contents)
    return engine


# --- sources ------------------------------------------------------------------------------


@entry(f"SELECT path, lang, text FROM {_values([('app/sample.go', 'go', GO_SOURCE), ('lib/parser.py', 'python', SOURCES['/lib/parser.py'])], 'path, lang, text')}")
def file_walk(spark, sf_dir):
    """Files below a folder that patterns take in and do not shut out, with their contents."""
    root = scratch(spark, "files")
    written = {p.lstrip("/"): t for p, t in SOURCES.items()} | {"vendor/x/y.go": "package y", "lib/deep/.git/z.py": "z = 1"}
    for name, text in written.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    found = files.read_documents(spark, root, ["**/*.go", "**/*.py"], ["**/vendor/**", "**/.git/**"])
    return found.select(F.regexp_extract("path", r"files-[0-9a-f]+/(.*)$", 1).alias("path"), "lang", "text")


@entry("""SELECT * FROM (VALUES (256, false, '["**/*.py"]', 10, 8000, 0.75)) t(chunk_tokens, stemming, includes, top_k, token_budget, b)""")
def settings(spark, sf_dir):
    """Defaults overlaid by a settings file, written out and read again."""
    text = 'index:\n  chunk_tokens: 256  # less\n  stemming: false\n  includes:\n    - "**/*.py"\nretrieve:\n  top_k: 10\npack:\n  token_budget: 8000\nunknown: 1\n'
    again = overlay(Config(), parse_settings(to_yaml(dataclasses.asdict(overlay(Config(), parse_settings(text))))))
    row = (again.index.chunk_tokens, again.index.stemming, json.dumps(list(again.index.includes)), again.retrieve.top_k, again.pack.token_budget, again.index.b)
    return spark.createDataFrame([row], "chunk_tokens int, stemming boolean, includes string, top_k int, token_budget int, b double")


# --- services -------------------------------------------------------------------------------


@entry("""SELECT * FROM (VALUES ('embedding', 'a', 1.0), ('embedding', 'bb', 2.0), ('embedding', 'ccc', 3.0), ('rerank', 'a', 0.0), ('rerank', 'bb', 0.9), ('chat', 'said', 1.0), ('requests', 'embedding', 2.0)) t(service, text, value)""")
def service_clients(spark, sf_dir):
    """What the clients of outside services make of (stand-in) answers: batches, places, counted tokens."""
    sent = []

    def post(url, body, key, timeout):
        sent.append(url)
        if "documents" in body:
            return {"results": [{"index": 1, "relevance_score": 0.9}]}
        if "messages" in body:
            return {"choices": [{"message": {"content": "said"}}]}
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    texts = ["a", "bb", "ccc"]
    rows = [("embedding", t, v[0]) for t, v in zip(texts, ports.http_embedder(overlay(Config(), {"embedding": {"batch_size": 2}}).embedding, post)(texts))]
    rows += [("requests", "embedding", float(len(sent)))]
    rows += [("rerank", t, float(v)) for t, v in zip(texts, ports.http_reranker("http://x", "m", "", post)("q", texts[:2]))]
    chat = ports.Chat("http://x", "m", post=post)
    rows.append(("chat", chat("hello there"), float(chat.tokens_out)))
    return spark.createDataFrame(rows, "service string, text string, value double")


@entry("""SELECT * FROM (VALUES (1, 'A'), (2, NULL), (3, 'C'), (4, NULL), (5, 'A'), (6, NULL), (7, NULL)) t(step, found)""")
def cached_results(spark, sf_dir):
    """A cache of two entries: found, not under another k, the least recently used one gone, too old, of an earlier index."""
    now = [0.0]
    cache = QueryCache(2, 10, lambda: now[0])
    cache.put("a", 1, "A")
    cache.put("b", 1, "B")
    seen = [cache.get("a", 1), cache.get("a", 2)]
    cache.put("c", 1, "C")
    seen += [cache.get("c", 1), cache.get("b", 1), cache.get("a", 1)]
    now[0] = 11.0
    seen.append(cache.get("a", 1))
    cache.put("d", 1, "D")
    cache.invalidate()
    seen.append(cache.get("d", 1))
    return spark.createDataFrame(list(enumerate(seen, 1)), "step int, found string")


# --- answers --------------------------------------------------------------------------------


@entry(f"""SELECT * FROM {_values([(1, 'old.txt', 1, 1, 'sessions'), (2, 'auth.txt', 1, 2, NAMED['auth.txt'])], 'rank, path, start_line, end_line, text')}""")
def result_json(spark, sf_dir):
    """Results as JSON text, read back: the shorter passage ranks first."""
    said = _engine(spark, NAMED).result_json("sessions", 5)
    rows = spark.createDataFrame([(said,)], "json string").select(F.inline(F.from_json("json", "array<struct<rank:int,path:string,start_line:int,end_line:int,score:double,text:string>>")))
    return rows.drop("score")


_CONTEXT = "=== old.txt:L1-1 ===\nsessions\n\n=== auth.txt:L1-2 ===\nhow sessions are closed\nand opened again\n\n"
_MORE = "=== db.txt:L1-1 ===\nrows and tables\n\n"


@entry(f"""SELECT * FROM {_values([('fast', 'told', 1, _CONTEXT), ('enough', 'told', 1, _CONTEXT), ('a line', 'told', 2, _CONTEXT + _MORE)], 'way, answer, rounds, context')}""")
def agent_rounds(spark, sf_dir):
    """The agent's loop with a (stand-in) model: one round, enough at once, and a place it asks to see."""
    engine = _engine(spark, NAMED)
    rows = []
    for way, decision in (("fast", ""), ("enough", '{"sufficient": true}'), ("a line", 'Look: {"sufficient": false, "lines": [{"file": "db.txt", "line": 1}]}')):
        agent = Agent(engine, lambda prompt, said=decision: said if "Reply in JSON" in prompt else "told", k=4, budget=200)
        got = agent.run("sessions", fast=way == "fast")
        rows.append((way, got["answer"], got["rounds"], got["context"]))
    return spark.createDataFrame(rows, "way string, answer string, rounds int, context string")


# --- maintenance ----------------------------------------------------------------------------


@entry(f"SELECT {_id(_GO_DOC, 'name', 'line')} AS id, name, type, line, signature FROM {_values(_SYMBOLS, 'name, type, line, signature')}")
def stored_symbols(spark, sf_dir):
    """The stored symbols of one document."""
    return _go_engine(spark).store.doc_symbols(_go_doc(spark)).select("id", "name", "type", "line", "signature")


@entry(" UNION ALL ".join(f"SELECT {_symbol(a)} AS caller_id, {_callee(b)} AS callee_id, {n} AS line" for a, b, n in _CALLS))
def stored_calls(spark, sf_dir):
    """The stored calls of one document."""
    return _go_engine(spark).store.doc_calls(_go_doc(spark)).select("caller_id", "callee_id", "line")


def _go_doc(spark: SparkSession) -> str:
    return spark.range(1).select(tx.doc_id(F.lit("/app/sample.go"))).first()[0]


def _go_engine(spark: SparkSession) -> Engine:
    engine = Engine(spark, scratch(spark, "code"))
    docs = spark.createDataFrame([("/app/sample.go", GO_SOURCE), ("/b.py", "def f():\n    pass\n")], "path string, text string")
    engine.index(docs.select(tx.doc_id("path").alias("doc_id"), "path", "text", F.to_timestamp(F.lit("2024-01-01")).alias("mod_time"), tx.detect_language("path").alias("lang")))
    return engine


@entry("""SELECT * FROM (VALUES ('a', 1.0, 0.0), ('b', 0.5, 0.5), ('c', 0.0, 1.0)) t(id, x, y)""")
def vector_upsert(spark, sf_dir):
    """Stored vectors: b is replaced, c is new."""
    engine = Engine(spark, scratch(spark, "vectors"))
    for rows in ([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], [("b", [0.5, 0.5]), ("c", [0.0, 1.0])]):
        engine.store.upsert_vectors(engine.config, spark.createDataFrame(rows, "id string, vector array<double>").withColumn("metadata", F.create_map().cast("map<string,string>")))
    return engine.store.read("vectors").select("id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@entry("""SELECT * FROM (VALUES ('none', true, false), ('same', false, false), ('other settings', false, true), ('newer version', false, true)) t(state, needs_migration, needs_rebuild)""")
def index_versions(spark, sf_dir):
    """Whether an index fits the version and the settings."""
    engine = Engine(spark, scratch(spark, "versions"), overlay(Config(), LINES))
    rows = [("none", engine.store.check(engine.config))]
    engine.index_memory({"a.txt": "words"})
    rows.append(("same", engine.store.check(engine.config)))
    rows.append(("other settings", engine.store.check(overlay(engine.config, {"index": {"chunk_tokens": 9}}))))
    engine.store.save_manifest(engine.store.manifest() | {"version": 99})
    rows.append(("newer version", engine.store.check(engine.config)))
    return spark.createDataFrame([(name, m.needs_migration, m.needs_rebuild) for name, m in rows], "state string, needs_migration boolean, needs_rebuild boolean")


@entry("""SELECT * FROM (VALUES ('missing, not allowed', 'no index found', 0), ('missing', '[]', 3), ('nothing changed', '[]', 3), ('changed, refused', '["auth.txt", "db.txt (deleted)", "old.txt"]', 3), ('changed', '["auth.txt", "db.txt (deleted)", "old.txt"]', 2)) t(step, said, n_docs)""")
def index_on_demand(spark, sf_dir):
    """An index made when it is missing and brought up to date when documents changed, if that is allowed."""
    engine = Engine(spark, scratch(spark, "demand"), overlay(Config(), LINES))
    early, late = (F.to_timestamp(F.lit(f"2024-01-0{d}")) for d in (1, 2))
    docs = corpus.in_memory(spark, NAMED).withColumn("mod_time", early)
    later = docs.where("path != 'db.txt'").withColumn("mod_time", late)
    rows = []
    for step, snapshot, options in (("missing, not allowed", docs, {"auto": False}), ("missing", docs, {}), ("nothing changed", docs, {}), ("changed, refused", later, {"ask": lambda question: False}), ("changed", later, {})):
        try:
            said = json.dumps(engine.ensure(snapshot, **options))
        except LookupError as missing:
            said = str(missing)
        rows.append((step, said, engine.stats()["total_docs"]))
    return spark.createDataFrame(rows, "step string, said string, n_docs int")
