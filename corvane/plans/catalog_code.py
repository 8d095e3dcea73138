"""Queries over source code.

The tables hold no code, so these read the small sources of ``samples``; their
oracles state the expected rows, with identities hashed in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, code, expand, golang, retrieval
from corvane.plans.catalog import _DOCS, _chunk_ctes, _tokens, entry
from corvane.plans.samples import EDGES, GO_SOURCE, PATHS, SOURCES
from corvane.sources import corpus


def _sources(spark):
    rows = spark.createDataFrame([(p, t) for p, t in SOURCES.items()], "path string, text string")
    return rows.select(tx.doc_id("path").alias("doc_id"), "path", "text", tx.detect_language("path").alias("lang"))


def _go(spark):
    rows = spark.createDataFrame([("/app/sample.go", GO_SOURCE)], "path string, text string")
    return rows.select(tx.doc_id("path").alias("doc_id"), "path", "text", tx.detect_language("path").alias("lang"))


def _lit(x) -> str:
    """An SQL literal."""
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_lit, x)) + "]::VARCHAR[]"
    return "NULL" if x is None else str(x)


def _values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + f") t({columns})"


def _id(*parts: str) -> str:
    """The SQL of an identity of parts."""
    return f"substr(sha256({" || ':' || ".join(parts)}), 1, 16)"


_DOC = _id("path")
_GO_DOC = _id("'/app/sample.go'")


# --- imports and related documents --------------------------------------------------------


@entry(f"SELECT * FROM {_values([('/app/sample.go', 'example.org/shop/cart'), ('/web/form.ts', 'shop/cart/view')], 'path, imported')}")
def import_expand(spark, sf_dir):
    return _sources(spark).select("path", F.explode(expand.imports("text")).alias("imported"))


def _tree(spark):
    """Documents of all sample paths, one passage each."""
    docs = spark.createDataFrame([(p, f"text of {p}") for p in PATHS], "path string, text string")
    docs = docs.select(tx.doc_id("path").alias("doc_id"), "path", "text", tx.detect_language("path").alias("lang"))
    return docs, docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("start_line"), "text")


_RELATED = [("/app/user_test.go", 0.4), ("/app/types.go", 0.4), ("/app/user_store.go", 0.4), ("/lib/test_parser.py", 0.2), ("/lib/parse_tools.py", 0.2)]


@entry(f"SELECT path, score FROM {_values(_RELATED, 'path, score')}")
def related_passages(spark, sf_dir):
    """Passages of documents related to two hits: tests, siblings and interface files, each at half the hit's score."""
    docs, chunks = _tree(spark)
    hits = chunks.join(docs.select("doc_id", "path"), "doc_id").where("path in ('/app/user.go', '/lib/parser.py')")
    hits = hits.withColumns({"rank": F.when(F.col("path") == "/app/user.go", 1).otherwise(2), "score": F.when(F.col("path") == "/app/user.go", 0.8).otherwise(0.4)})
    found = expand.related(hits.select("rank", "chunk_id", "doc_id", "score"), chunks, docs)
    return found.join(docs, "doc_id").select("path", F.round("score", 6).alias("score"))


@entry(f"SELECT path, score FROM {_values([('/go/example.org/shop/cart/cart.go', 0.3), ('/web/shop/cart/view', 0.3)], 'path, score')}")
def imported_passages(spark, sf_dir):
    """First passages of the documents that the hits import."""
    paths = ["/go/example.org/shop/cart/cart.go", "/web/shop/cart/view", "/web/shop/other.ts", "/go/strings/strings.go"]
    docs = spark.createDataFrame([(p,) for p in paths], "path string").select(tx.doc_id("path").alias("doc_id"), "path")
    chunks = docs.crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("start_line"))).withColumn("chunk_id", F.concat_ws("-", "doc_id", F.col("start_line").cast("string")))
    found = expand.imported(_sources(spark).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text"), chunks, docs)
    return found.where(F.endswith("chunk_id", F.lit("-1"))).join(docs, "doc_id").select("path", "score")


# --- symbols and comments -------------------------------------------------------------------

_PREFIXED = [
    ("/lib/parser.py", "Parser", "class", 6, "class Parser(Base):"),
    ("/lib/parser.py", "read", "function", 10, "def read(self, text):"),
    ("/lib/parser.py", "Plain", "class", 13, "class Plain:"),
    ("/lib/parser.py", "__init__", "function", 14, "def __init__(self):"),
    ("/web/form.ts", "Form", "class", 6, "class Form extends Base {"),
    ("/web/form.ts", "size", "constant", 8, "const size = 3"),
    ("/web/form.ts", "count", "variable", 9, "let count=0"),
    ("/web/form.ts", "draw", "function", 10, "function draw(x) { return x }"),
    ("/src/App.java", "App<T>", "class", 1, "public class App<T> {"),
    ("/src/App.java", "Inner", "class", 2, "private class Inner {"),
    ("/src/App.java", "Shape", "interface", 5, "interface Shape {"),
    ("/src/App.java", "Round", "interface", 7, "public interface Round extends Shape { }"),
]


@entry(f"SELECT {_id(_DOC, 'name', 'line')} AS id, name, type, {_DOC} AS doc_id, line, signature FROM {_values(_PREFIXED, 'path, name, type, line, signature')}")
def symbols_by_prefix(spark, sf_dir):
    return code.prefix_symbols(_sources(spark))


@entry(f"SELECT id, name FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in sorted({(e[0], e[0]) for e in EDGES} | {(e[1], e[1]) for e in EDGES}))}) t(id, name) WHERE contains(lower(name), 'pars')")
def symbol_search(spark, sf_dir):
    names = sorted({e[0] for e in EDGES} | {e[1] for e in EDGES})
    return retrieval.symbol_search(spark.createDataFrame([(n, n) for n in names], "id string, name string"), "PARS")


_COMMENTS = [
    ("/app/sample.go", "line", "Package sample holds one of each kind of declaration.", 1, 1),
    ("/app/sample.go", "line", "Limit bounds a basket.", 11, 11),
    ("/app/sample.go", "line", "Item is one line of an order.", 19, 19),
    ("/app/sample.go", "line", "Store keeps items.", 26, 26),
    ("/app/sample.go", "line", "Add puts an item into the basket.", 35, 35),
    ("/lib/parser.py", "line", "A parser\nof small things", 2, 3),
    ("/lib/parser.py", "doc", "# TODO: speed", 4, 4),
    ("/lib/parser.py", "block", '"""Reads\n    text."""', 7, 8),
    ("/web/form.ts", "block", "one line", 2, 2),
    ("/web/form.ts", "block", "/*\n many lines\n*/", 3, 5),
    ("/web/form.ts", "doc", "// FIXME later", 11, 11),
    ("/web/form.ts", "line", "plain", 12, 12),
    ("/bin/run.sh", "line", "!/bin/sh\nstart\nthe server", 1, 3),
]
_COMMENTED = _values(_COMMENTS, "path, type, text, start_line, end_line")


@entry(f"SELECT {_DOC} AS doc_id, type, text, start_line, end_line FROM {_COMMENTED}")
def comments_extract(spark, sf_dir):
    return code.comments(_sources(spark))


@entry(f"SELECT {_DOC} AS doc_id, term, count(*) AS n FROM (SELECT path, unnest({_tokens('text')}) AS term FROM {_COMMENTED}) GROUP BY path, term")
def comment_tokens(spark, sf_dir):
    return code.comment_tokens(_sources(spark))


_EDGES = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in EDGES)


@entry(f"""WITH e(caller_id, callee_id, line) AS (VALUES {_EDGES}), s AS (SELECT DISTINCT caller_id AS id FROM e)
 SELECT DISTINCT 'callers' AS side, e.callee_id AS of_id, e.caller_id AS id FROM e JOIN s ON s.id = e.caller_id WHERE e.callee_id IN ('parse', 'read')
 UNION ALL SELECT DISTINCT 'callees', e.caller_id, e.callee_id FROM e JOIN s ON s.id = e.callee_id WHERE e.caller_id IN ('main', 'parse')""")
def call_graph_one_hop(spark, sf_dir):
    calls = spark.createDataFrame(EDGES, "caller_id string, callee_id string, line int")
    symbols = calls.select(F.col("caller_id").alias("id")).distinct()
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    into = code.callers(calls, symbols, ids("parse", "read")).select(F.lit("callers").alias("side"), "of_id", "id")
    return into.unionByName(code.callees(calls, symbols, ids("main", "parse")).select(F.lit("callees").alias("side"), "of_id", "id"))


# --- Go ---------------------------------------------------------------------------------------

_UNITS = [
    ("import", "imports", "", 4, 9, "", 0, [], ["fmt", "strings", "example.org/shop/cart"]),
    ("const", "Limit", "", 12, 12, "Limit bounds a basket.\n", 0, [], []),
    ("var", "first, second, names", "", 14, 17, "", 0, [], []),
    ("struct", "Item", "type Item struct", 20, 24, "Item is one line of an order.\n", 3, [], []),
    ("interface", "Store", "type Store interface", 27, 31, "Store keeps items.\n", 3, [], []),
    ("type", "Handler", "type Handler func(string) error", 33, 33, "", 0, [], []),
    ("method", "Add", "func (b *Basket) Add(item Item, n int) (total int, err error)", 36, 42, "Add puts an item into the basket.\n", 0, ["fmt.Errorf", "append", "b.Total"], []),
    ("method", "Total", "func (b *Basket) Total() int", 44, 51, "", 0, ["price", "log"], []),
    ("function", "price", "func price(i Item) int", 53, 53, "", 0, [], []),
    ("function", "log", "func log(text string)", 55, 57, "", 0, ["fmt.Println", "str.ToUpper"], []),
]
_UNIT_ROWS = _values(_UNITS, "type, name, signature, start_line, end_line, doc, n_children, calls, imports")


@entry(f"SELECT * FROM {_UNIT_ROWS}")
def go_units(spark, sf_dir):
    return golang.units(_go(spark)).select("type", "name", "signature", "start_line", "end_line", "doc", F.size("children").alias("n_children"), "calls", "imports")


_SYMBOLS = [
    ("Limit", "variable", 12, ""),
    ("first", "variable", 15, ""),
    ("second", "variable", 15, ""),
    ("names", "variable", 16, ""),
    ("Item", "struct", 20, "struct Item"),
    ("Store", "interface", 27, "interface Store"),
    ("Handler", "type", 33, "type Handler"),
    ("*Basket.Add", "method", 36, "func (*Basket) Add(item Item, n int) (int, error)"),
    ("*Basket.Total", "method", 44, "func (*Basket) Total() int"),
    ("price", "function", 53, "func price(i Item) int"),
    ("log", "function", 55, "func log(text string)"),
]
_LINES = {name: line for name, _, line, _ in _SYMBOLS}
_symbol = lambda name: _id(_GO_DOC, _lit(name), _lit(str(_LINES[name])))


@entry(f"SELECT {_id(_GO_DOC, 'name', 'line')} AS id, name, type, {_GO_DOC} AS doc_id, line, signature FROM {_values(_SYMBOLS, 'name, type, line, signature')}")
def go_symbols(spark, sf_dir):
    return golang.symbols(_go(spark))


# Calls inside function literals are no edges.
_CALLS = [("*Basket.Add", "fmt.Errorf", 38), ("*Basket.Add", "append", 40), ("*Basket.Add", "b.Total", 41), ("*Basket.Total", "price", 47), ("log", "fmt.Println", 56), ("log", "str.ToUpper", 56)]
_callee = lambda name: _symbol(name) if name in _LINES else _lit(name)


@entry(" UNION ALL ".join(f"SELECT {_GO_DOC} AS doc_id, {_symbol(a)} AS caller_id, {_callee(b)} AS callee_id, {n} AS line" for a, b, n in _CALLS))
def go_calls(spark, sf_dir):
    docs = _go(spark)
    return code.resolve_calls(golang.calls(docs), golang.symbols(docs))


def _metadata() -> str:
    """Each passage with the symbols that begin in it, what the first one calls, and who calls it."""
    out = []
    for kind, name, _, first, last, *_ in _UNITS:
        inside = [s for s in _SYMBOLS if first <= s[2] <= last]
        symbol = inside[0] if inside else (None, "", 0, None)
        shown = "function" if symbol[1] in ("method", "function") else symbol[1] if symbol[1] in ("struct", "interface", "type") else "mixed"
        calls = [_callee(b) for a, b, _ in _CALLS if a == symbol[0]]
        called = [_symbol(a) for a, b, _ in _CALLS if b == symbol[0]]
        listed = lambda xs: f"[{', '.join(xs)}]::VARCHAR[]"
        out.append(f"SELECT {_id(_GO_DOC, _lit(kind), _lit(name), _lit(str(first)))} AS chunk_id, {_lit(shown)} AS type, {_lit(symbol[0])} AS name, {_lit(symbol[3])} AS signature, {listed([_symbol(s[0]) for s in inside])} AS symbols, {listed(calls)} AS calls, {listed(called)} AS called_by, []::VARCHAR[] AS imports")
    return " UNION ALL ".join(out)


@entry(_metadata())
def chunk_metadata(spark, sf_dir):
    docs = _go(spark)
    chunks = chunking.composite_chunks(docs)
    symbols = golang.symbols(docs)
    return code.chunk_metadata(chunks, symbols, code.resolve_calls(golang.calls(docs), symbols))


_OTHERS = _values([(-i, p, t) for i, (p, t) in enumerate(SOURCES.items(), 1)], "num, path, text")
_BOTH = f"SELECT num, doc_id, regexp_split_to_array(text, chr(10)) AS ls FROM docs UNION ALL SELECT num, {_DOC}, regexp_split_to_array(text, chr(10)) FROM {_OTHERS} WHERE NOT suffix(path, '.go')"


@entry(f"""WITH RECURSIVE {_DOCS}, {_chunk_ctes(64, 10, _BOTH)}, named AS (SELECT num, path FROM docs UNION ALL SELECT num, path FROM {_OTHERS})
 SELECT n.path, c.chunk_id, c.start_line, c.end_line, c.text FROM chunks c JOIN named n USING (num)
 UNION ALL SELECT '/app/sample.go', {_id(_GO_DOC, 'type', 'name', 'start_line')}, start_line, end_line,
  CASE WHEN doc <> '' THEN '// ' || doc || chr(10) ELSE '' END || array_to_string(string_split({_lit(GO_SOURCE)}, chr(10))[start_line:end_line], chr(10)) FROM {_UNIT_ROWS}""")
def composite_chunks(spark, sf_dir):
    """All documents and the sample sources: Go by declarations, everything else by lines."""
    docs = corpus.documents(spark, sf_dir).select("doc_id", "path", "text", "lang").unionByName(_sources(spark))
    return chunking.composite_chunks(docs, 64, 10).select("path", "chunk_id", "start_line", "end_line", "text")
