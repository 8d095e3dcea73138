"""Queries over the stored index, the maintenance of it, and what is left of text and expansion."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.config import Config, overlay
from corvane.functions import text as tx, vector
from corvane.operators import expand, index, packing, retrieval
from corvane.plans.agent import variants
from corvane.plans.cache import QueryCache
from corvane.plans.catalog import _BENCH, _CHUNKS, _DOCS, _LINEBM, _ONE, MOST, OVERLAP, QUERY, REPEATED, _asked, _bm25, _count, _packable, _tokens, _whole, entry
from corvane.plans.engine import Engine
from corvane.plans.facade import Facade
from corvane.sources import corpus
from corvane.sources.store import scratch

SETTINGS = {"index": {"chunk_tokens": MOST, "chunk_overlap": OVERLAP, "stemming": False, "ast_chunking": False}, "retrieve": {"path_boost_weight": 0.0}, "embedding": {"enabled": True, "dimension": 16}}


def _made(spark: SparkSession, docs: DataFrame) -> Engine:
    engine = Engine(spark, scratch(spark, "index"), overlay(Config(), SETTINGS))
    engine.index(docs.drop("num"))
    return engine


@functools.lru_cache(maxsize=4)
def _stored(spark: SparkSession, sf_dir: str) -> Engine:
    """The whole documents table, indexed once for the queries that only read it."""
    return _made(spark, corpus.documents(spark, sf_dir))


def _num():
    """The number in the path of a document."""
    return F.regexp_extract("path", r"doc_(-?\d+)\.txt$", 1).cast("long")


def _sizes_sql(d: str, c: str) -> str:
    """Rows of every table for relations of documents and passages."""
    terms = f"SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM {c})"
    return " UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM {of}) AS n" for name, of in (("docs", d), ("chunks", c), ("vectors", c), ("postings", f"({terms})")))


def _sizes(engine: Engine) -> DataFrame:
    """Rows of every table of documents."""
    parts = [engine.store.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("docs", "chunks", "vectors", "postings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@entry(f"WITH RECURSIVE {_CHUNKS} {_sizes_sql('docs', 'chunks')}")
def stored_sizes(spark, sf_dir):
    """Rows of the tables that indexing makes."""
    return _sizes(_stored(spark, sf_dir))


@entry(f"WITH RECURSIVE {_LINEBM.replace('@source', 'cand')} SELECT r.chunk_id, c.num AS doc_num, round(r.score, 6) AS score, r.rank FROM ranked r JOIN chunks c USING (chunk_id) WHERE r.rank <= 15")
def stored_search(spark, sf_dir):
    """BM25 from stored postings."""
    engine = _stored(spark, sf_dir)
    found = engine.retrieve(engine.queries(QUERY), 15, "bm25", diverse=False)
    return found.select("chunk_id", _num().alias("doc_num"), F.round("score", 6).alias("score"), "rank")


@entry(f"WITH RECURSIVE {_CHUNKS} SELECT c.chunk_id, c.start_line, c.end_line, c.text, d.path FROM chunks c JOIN docs d USING (num) WHERE c.num = 5")
def stored_lookup(spark, sf_dir):
    """One document by its id, and its passages."""
    engine = _stored(spark, sf_dir)
    doc = engine.store.read("docs").where(_num() == 5).first()
    path = engine.store.doc(doc.doc_id).path
    return engine.store.doc_chunks(doc.doc_id).select("chunk_id", "start_line", "end_line", "text", F.lit(path).alias("path"))


@entry(f"WITH RECURSIVE {_CHUNKS} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM chunks) WHERE term IN ('ering', 'que', 'der') GROUP BY term, chunk_id")
def stored_postings(spark, sf_dir):
    """Stored postings of three terms."""
    return _stored(spark, sf_dir).store.term_postings("ering", "que", "der").select("term", "chunk_id", "tf")


@entry(f"WITH RECURSIVE {_CHUNKS} SELECT count(DISTINCT doc_id) AS total_docs, count(*) AS total_chunks, round(avg(len({_tokens('text')})), 6) AS avg_chunk_len FROM chunks")
def stored_stats(spark, sf_dir):
    found = _stored(spark, sf_dir).stats()
    return spark.createDataFrame([(found["total_docs"], found["total_chunks"], round(found["avg_chunk_len"], 6))], "total_docs long, total_chunks long, avg_chunk_len double")


@entry(f"WITH RECURSIVE {_CHUNKS}, d AS (SELECT * FROM docs WHERE num % 3 <> 0), c AS (SELECT * FROM chunks WHERE num % 3 <> 0) {_sizes_sql('d', 'c')}")
def delete_cascade(spark, sf_dir):
    """A third of the documents deleted, with all that belongs to them."""
    engine = _made(spark, corpus.documents(spark, sf_dir))
    engine.store.delete_docs(engine.config, engine.store.read("docs").where(_num() % 3 == 0))
    return _sizes(engine)


def _changed(docs: DataFrame) -> DataFrame:
    """A later snapshot: every seventh document is gone, every fifth has another text."""
    touched = F.col("num") % 5 == 0
    later = docs.where("num % 7 <> 0").withColumns({"text": F.when(touched, F.concat("text", F.lit("\nfurther words at the end"))).otherwise(F.col("text")), "mod_time": F.when(touched, F.col("mod_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mod_time"))})
    return later


_LATER = _CHUNKS.replace("SELECT num, doc_id, regexp_split_to_array(text, chr(10)) AS ls FROM docs", "SELECT num, doc_id, regexp_split_to_array(CASE WHEN num % 5 = 0 THEN text || chr(10) || 'further words at the end' ELSE text END, chr(10)) AS ls FROM docs WHERE num % 7 <> 0")


@entry(f"WITH RECURSIVE {_LATER}, d AS (SELECT * FROM docs WHERE num % 7 <> 0) {_sizes_sql('d', 'chunks')}")
def incremental_index(spark, sf_dir):
    """An index brought up to date with a later snapshot."""
    docs = corpus.documents(spark, sf_dir)
    engine = _made(spark, docs)
    engine.index(_changed(docs).drop("num"))
    return _sizes(engine)


@entry(f"""WITH {_DOCS} SELECT path, CASE WHEN num % 7 = 0 THEN 'delete' ELSE 'update' END AS status FROM docs WHERE num % 7 = 0 OR num % 5 = 0""")
def changed_documents(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return index.changed(docs, _changed(docs))


def _mock_sql(text: str) -> str:
    """The stand-in embedding of an SQL text in 16 dimensions, as doubles of floats."""
    cs = f"string_split(coalesce({text}, ''), '')[1:16]"
    return f"list_transform(range(1, 17), lambda p: (coalesce(list_sum(list_transform(range(1, len({cs}) + 1), lambda i: CASE WHEN 1 + list_sum(list_transform(list_prepend('', ({cs})[1:i - 1]), lambda x: strlen(x))) = p THEN unicode(({cs})[i]) ELSE 0 END)), 0) / 1000)::FLOAT::DOUBLE)"


@entry(f"""WITH {_DOCS}, q AS (SELECT {_mock_sql(f"'{REPEATED}'")} AS q), v AS (SELECT num, doc_id, {_mock_sql('text')} AS v FROM docs),
 s AS (SELECT num, doc_id, round(CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))) END, 9) AS score FROM v CROSS JOIN q),
 r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT num, round(score, 8) AS score, rank FROM r WHERE rank <= 10""")
def hyde_search(spark, sf_dir):
    """Search by a passage that a (stand-in) model writes."""
    docs = corpus.documents(spark, sf_dir)
    vectors = docs.select(F.col("doc_id").alias("id"), vector.mock_embedding("text", 16).alias("vector"))

    def embed(texts):
        out = []
        for t in texts:
            v = [0.0] * 16
            at = 0
            for ch in t:
                if at < 16:
                    v[at] = ord(ch) / 1000
                at += len(ch.encode())
            out.append(v)
        return out

    said = REPEATED
    asked = _asked(spark, QUERY)
    written = asked.select("query_id", "text")
    found = retrieval.hyde(written, lambda prompt: said, embed, vectors.withColumn("vector", F.col("vector").cast("array<float>")), docs.select(F.col("doc_id").alias("chunk_id")), 10)
    return retrieval.with_columns_of(found.withColumn("score", F.round("score", 9)), docs.withColumnRenamed("doc_id", "chunk_id"), asked, 10, "num").select("num", F.round("score", 8).alias("score"), "rank")


@entry(f"WITH {_bm25("(SELECT * FROM (VALUES (0::BIGINT, ''), (1, 'the of and'), (2, 'zzunknownzz')) t(query_id, text))")} SELECT query_id, num AS doc_num, score, rank FROM ranked")
def bm25_no_hits(spark, sf_dir):
    """Queries without words, of stop words, and of words that no passage holds."""
    found = retrieval.bm25(_asked(spark, "", "the of and", "zzunknownzz"), _whole(spark, sf_dir), 5, keep=("num",))
    return found.select("query_id", F.col("num").alias("doc_num"), "score", "rank")


@entry("SELECT 'zzunknownzz' AS query, 50 AS budget_tokens, 0::BIGINT AS used_tokens, 0 AS n_snippets")
def packed_nothing(spark, sf_dir):
    """A context without candidates."""
    asked = _asked(spark, "zzunknownzz")
    found = retrieval.bm25(asked, _whole(spark, sf_dir), 5, keep=("num", "doc_id", "path", "mod_time", "start_line", "end_line", ))
    packed = packing.packed_context(asked, found.withColumn("text", F.lit("")), corpus.documents(spark, sf_dir), 50)
    return packed.select("query", "budget_tokens", F.col("used_tokens").cast("long").alias("used_tokens"), F.size("snippets").alias("n_snippets"))


@entry(f"""WITH RECURSIVE {_LINEBM.replace('@source', 'chosen')} SELECT '{QUERY}' AS query, path, 'L' || start_line || '-' || end_line AS range, text FROM merged""")
def packed_json(spark, sf_dir):
    """A packed context as JSON, read back."""
    packed = packing.packed_context(_asked(spark, QUERY), _packable(spark, sf_dir), corpus.documents(spark, sf_dir), 400)
    back = F.from_json("json", "query string, budget_tokens int, used_tokens long, snippets array<struct<path:string,range:string,why:string,text:string>>")
    rows = packing.context_json(packed).select(back.alias("j")).select("j.query", F.explode("j.snippets").alias("s"))
    return rows.select("query", "s.path", "s.range", "s.text")


# --- text and identities --------------------------------------------------------------


@entry(f"WITH {_DOCS} SELECT num, CASE WHEN len(string_split(path, '/')) > 2 THEN list_last(string_split(path, '/')) ELSE path END AS short FROM docs")
def short_paths(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("num", tx.short_path("path").alias("short"))


@entry(f"WITH {_DOCS} SELECT num, CASE WHEN suffix(text, chr(10)) OR text = '' THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END::INT AS n_lines FROM docs")
def full_lines(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("num", F.size(tx.full_lines("text")).alias("n_lines"))


@entry(f"WITH {_DOCS} SELECT num, substr(sha256(doc_id || ':function:run:' || (num % 9 + 1)), 1, 16) AS unit, substr(sha256(doc_id || ':run:' || (num % 9 + 1)), 1, 16) AS symbol FROM docs")
def unit_ids(spark, sf_dir):
    """Identities of a declaration and of its symbol, one for each document."""
    line = F.col("num") % 9 + 1
    return corpus.documents(spark, sf_dir).select("num", tx.unit_chunk_id("doc_id", F.lit("function"), F.lit("run"), line).alias("unit"), tx.symbol_id("doc_id", F.lit("run"), line).alias("symbol"))


@entry("""SELECT substr(sha256('{"stemming":true,"chunk_tokens":512,"chunk_overlap":50,"k1":1.2,"b":0.75,"ast_chunking":true,"emb_enabled":false,"emb_provider":"openai","emb_model":"text-embedding-3-small"}'), 1, 16) AS config_hash, substr(sha256('some words' || chr(0) || chr(5)), 1, 32) AS cache_key""")
def configuration_keys(spark, sf_dir):
    """The hash of the default settings, and the key of a cached query."""
    return spark.createDataFrame([(Config().index_hash(), QueryCache.key("some words", 5))], "config_hash string, cache_key string")


@entry(f"SELECT substr(sha256(path), 1, 16) AS doc_id, path, text, 'text' AS lang FROM (VALUES ('a.txt', 'first words'), ('b/c.md', '')) t(path, text)")
def memory_corpus(spark, sf_dir):
    return corpus.in_memory(spark, {"a.txt": "first words", "b/c.md": ""}).select("doc_id", "path", "text", "lang")


# --- expansion --------------------------------------------------------------------------


@entry(f"""WITH {_DOCS}, w(name, line) AS (VALUES ('doc_7.txt', 3), ('doc_11.txt', 1), ('no such file', 2)), f AS (
  SELECT w.name, w.line, d.path, string_split(d.text, chr(10)) AS ls, row_number() OVER (PARTITION BY w.name, w.line ORDER BY suffix(d.path, w.name) DESC, d.path) AS r FROM docs d JOIN w ON contains(d.path, w.name)
) SELECT name, line, path, greatest(line - 2, 1)::INT AS start_line, least(line + 2, len(ls))::INT AS end_line, coalesce(array_to_string(ls[greatest(line - 2, 1):least(line + 2, len(ls))], chr(10)), '') AS text FROM f WHERE r = 1""")
def around_line(spark, sf_dir):
    """Lines around a place named by file and line."""
    wanted = spark.createDataFrame([("doc_7.txt", 3), ("doc_11.txt", 1), ("no such file", 2)], "name string, line int")
    return expand.around_line(wanted, corpus.documents(spark, sf_dir), 2)


_SAID = "Here they are:\n- a list\n1. how sessions close\n2. close a session\n\nclose a session\nwhere sessions end\nand more\nand yet more"


@entry("""SELECT * FROM (VALUES (0, 'how are sessions closed', 'generated'), (1, 'how sessions close', 'generated'), (2, 'close a session', 'generated'), (3, 'where sessions end', 'generated'), (4, 'and more', 'generated'),
  (0, 'how sessions close', 'variants'), (1, 'close a session', 'variants'), (2, 'close a session', 'variants'), (3, 'where sessions end', 'variants'), (4, 'and more', 'variants'), (5, 'and yet more', 'variants')) t(place, text, rule)""")
def generated_queries(spark, sf_dir):
    """Queries that a model lists, by the two rules that read its answer."""
    first = expand.generated("how are sessions closed", lambda prompt: _SAID)
    rows = [(i, t, "generated") for i, t in enumerate(first)] + [(i, t, "variants") for i, t in enumerate(variants(_SAID))]
    return spark.createDataFrame(rows, "place int, text string, rule string")


@entry(f"""WITH {_bm25(_BENCH)}, u AS (SELECT DISTINCT num FROM ranked WHERE rank <= 3) SELECT count(*) AS n FROM u""")
def agent_pool(spark, sf_dir):
    """Passages in the pool of many searches."""
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.pooled(retrieval.bm25(asked, _whole(spark, sf_dir), 3)).agg(F.count("*").alias("n"))


_NAMED = {"auth.txt": "how sessions are closed\nand opened again", "db.txt": "rows and tables", "old.txt": "sessions"}


@entry("""SELECT * FROM (VALUES ('index', 'true', NULL, NULL), ('stats', NULL, '["auth.txt","db.txt","old.txt"]', NULL), ('query', NULL, NULL, '["auth.txt","old.txt"]'), ('again', 'true', NULL, NULL), ('query again', NULL, NULL, '["auth.txt"]'), ('clear', 'true', NULL, NULL), ('empty', NULL, '[]', NULL)) t(step, success, files, found)""")
def facade_steps(spark, sf_dir):
    """The embedded interface: index three contents, search, replace one, clear."""
    facade = Facade(spark, scratch(spark, "facade"))
    said = [("index", [facade.index(name, content) for name, content in _NAMED.items()][-1]), ("stats", facade.stats()), ("query", facade.query("sessions")), ("again", facade.index("old.txt", "other words")), ("query again", facade.query("sessions")), ("clear", facade.clear()), ("empty", facade.stats())]
    rows = spark.createDataFrame(said, "step string, json string")
    paths = F.from_json(F.get_json_object("json", "$.results"), "array<struct<path:string>>")
    return rows.select("step", F.get_json_object("json", "$.success").alias("success"), F.get_json_object("json", "$.files").alias("files"), F.to_json(F.sort_array(F.transform(paths, lambda p: p["path"]))).alias("found"))
