"""Wider queries and wider context."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import text as tx
from corvane.operators.retrieval import small

# Abbreviations and the words that take their place.
SYNONYMS = {
    "auth": ["authentication", "login", "authorize"],
    "config": ["configuration", "settings", "options"],
    "db": ["database", "storage", "persistence"],
    "err": ["error", "exception", "failure"],
    "func": ["function", "method", "handler"],
    "init": ["initialize", "setup", "bootstrap"],
    "msg": ["message", "notification", "event"],
    "req": ["request", "input", "query"],
    "resp": ["response", "output", "result"],
    "util": ["utility", "helper", "common"],
    "api": ["endpoint", "route", "handler"],
    "test": ["testing", "spec", "unit test"],
    "validate": ["validation", "check", "verify"],
    "parse": ["parsing", "decode", "deserialize"],
    "serialize": ["encoding", "marshal", "format"],
    "async": ["asynchronous", "concurrent", "parallel"],
    "cache": ["caching", "memoize", "store"],
    "log": ["logging", "logger", "trace"],
    "middleware": ["interceptor", "filter", "handler"],
}
# Name parts of test files, folders of tests, parts of interface files, prefixes of imports that are left out.
TEST_NAMES = ["_test", ".test", ".spec", "test_"]
TEST_FOLDERS = ["/test/", "/tests/", "/__tests__/"]
CONTRACT_NAMES = ["interface", "types", "contract"]
STANDARD_PREFIXES = ["fmt", "os", "io", "net", "encoding", "sync"]
#: Queries of one expansion, the original among them.
MOST_QUERIES = 5


# --- queries --------------------------------------------------------------------


def keywords(queries: DataFrame) -> DataFrame:
    """query_id, variant and text: the query, then up to four with an abbreviation replaced.

    Replacements are taken in the order of abbreviation and synonym.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i"), F.lit(s).alias("s")) for a in sorted(SYNONYMS) for i, s in enumerate(SYNONYMS[a])])
    low = F.lower("text")
    fit = F.filter(F.transform(F.filter(pairs, lambda p: F.contains(low, p["a"])), lambda p: F.replace(low, p["a"], p["s"])), lambda t: t != low)
    all_ = F.slice(F.concat(F.array("text"), fit), 1, MOST_QUERIES)
    return queries.select("query_id", F.posexplode(all_).alias("variant", "text"))


def generated(query: str, generate: Callable[[str], str] | None, most: int = MOST_QUERIES - 1) -> list[str]:
    """The query and what a language model adds: lines without bullets and colons, numbers stripped."""
    if generate is None:
        return [query]
    try:
        said = generate(f"Give {most} other search queries for this one, each on its own line.\n\n{query}")
    except Exception:
        return [query]
    found = [query]
    for line in said.splitlines():
        line = line.strip()
        if not line or line.startswith("-") or ":" in line:
            continue
        line = line.lstrip("0123456789. ").strip()
        if line and line not in found and len(found) <= most:
            found.append(line)
    return found


# --- lines ----------------------------------------------------------------------


def around(hits: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Hits (with doc_id, start_line, end_line) with their text widened by n lines each way, as far as there are lines."""
    lines = tx.lines_of("doc_text")
    rows = hits.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").withColumn("lines", lines)
    first, last = F.greatest(F.col("start_line") - n, F.lit(1)), F.least(F.col("end_line") + n, F.size("lines"))
    kept = [c for c in hits.columns if c not in ("text", "start_line", "end_line")]
    return rows.select(*kept, first.alias("start_line"), last.alias("end_line"), tx.line_slice(F.col("lines"), first, last).alias("text"))


def around_line(wanted: DataFrame, docs: DataFrame, n: int = 50) -> DataFrame:
    """For (name, line): the n lines each way, in the documents whose path ends with or holds the name.

    The wanted names are a small set; of several paths the first is taken.
    """
    asked = small(wanted.select("name", "line"), 1000)
    rows = docs.select("path", "text").join(asked, F.col("path").endswith(F.col("name")) | F.contains("path", F.col("name")))
    first = F.row_number().over(Window.partitionBy("name", "line").orderBy(F.desc(F.col("path").endswith(F.col("name"))), "path"))
    rows = rows.withColumn("r", first).where("r = 1").withColumn("lines", tx.lines_of("text"))
    a, b = F.greatest(F.col("line") - n, F.lit(1)), F.least(F.col("line") + n, F.size("lines"))
    return rows.select("name", "line", "path", a.alias("start_line"), b.alias("end_line"), tx.line_slice(F.col("lines"), a, b).alias("text"))


# --- related documents ------------------------------------------------------------


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(_base(path), r"\.[^.]*$", "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_test(path: Column) -> Column:
    found = F.lit(False)
    for part in TEST_NAMES:
        found = found | F.contains(_stem(path), F.lit(part))
    for part in TEST_FOLDERS:
        found = found | F.contains(path, F.lit(part))
    return found


def is_related(path: Column, lang: Column, other: Column, other_lang: Column, tests: bool = True, siblings: bool = True, contracts: bool = True) -> Column:
    """Whether ``other`` is a test of ``path`` or its subject, a sibling with the same first half of a name, or a Go interface file."""
    name, peer = _stem(path), _stem(other)
    found = F.lit(False)
    if tests:
        found = found | (is_test(other) & ~is_test(path) & F.contains(peer, name))
        found = found | (~is_test(other) & is_test(path) & F.contains(name, peer))
    if siblings:
        shorter = F.least(F.octet_length(name), F.octet_length(peer))
        half = F.floor(shorter / 2).cast("int")
        found = found | ((_folder(path) == _folder(other)) & (shorter >= 4) & (F.substring(name, F.lit(1), half) == F.substring(peer, F.lit(1), half)))
    if contracts:
        holds = F.lit(False)
        for part in CONTRACT_NAMES:
            holds = holds | F.contains(_base(other), F.lit(part))
        found = found | ((lang == "go") & (other_lang == "go") & holds)
    return found


def related(hits: DataFrame, chunks: DataFrame, docs: DataFrame, most: int = 3, **rules) -> DataFrame:
    """chunk_id and score of up to ``most`` passages of related documents for each hit, at half its score.

    Hits are a small ranked list (rank, chunk_id, doc_id, score).  A document
    belongs to the first hit that it is related to; documents and passages of
    the hits are left out.
    """
    ranked = hits.join(docs.select("doc_id", "path", "lang"), "doc_id")
    first = ranked.groupBy("doc_id", "path", "lang").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    asked = small(first.select("rank", "score", F.col("path").alias("p"), F.col("lang").alias("l")), 2000)
    rest = docs.join(small(hits.select("doc_id").distinct()), "doc_id", "left_anti")
    pairs = rest.select("doc_id", "path", "lang").join(asked, is_related(F.col("p"), F.col("l"), F.col("path"), F.col("lang"), **rules))
    owner = pairs.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    parts = chunks.join(small(owner), "doc_id").join(small(hits.select("chunk_id")), "chunk_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("rank").orderBy("doc_id", "start_line", "chunk_id"))
    return parts.withColumn("place", place).where(F.col("place") <= most).select("rank", "chunk_id", "doc_id", (F.col("score") * 0.5).alias("score"))


# --- imports --------------------------------------------------------------------


def import_lines(text) -> Column:
    """Lines of a text that import: inside a block in brackets, or each on its own."""
    lines = F.transform(tx.lines_of(text), F.trim)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s, line):
        opens = F.startswith(line, F.lit("import ("))
        closes = s["inside"] & (line == ")")
        takes = ~opens & ~closes & (s["inside"] | F.startswith(line, F.lit("import ")))
        inside = F.when(opens, True).when(closes, False).otherwise(s["inside"])
        return F.struct(inside.alias("inside"), F.when(takes, F.concat(s["found"], F.array(line))).otherwise(s["found"]).alias("found"))

    return F.aggregate(lines, start, step, lambda s: s["found"])


def import_path(line: Column) -> Column:
    """The last word of an import line without quotes."""
    word = F.element_at(F.split(F.trim(F.regexp_replace(line, "^import ", "")), r"\s+"), -1)
    return F.regexp_replace(word, "^[\"'`]+|[\"'`]+$", "")


def import_paths(text) -> Column:
    """Every imported path of a text."""
    return F.filter(F.transform(import_lines(text), import_path), lambda p: p != "")


def imports(text) -> Column:
    """Distinct imported paths with a slash whose beginning is no standard package's name."""
    standard = lambda p: F.regexp_like(p, F.lit("^(" + "|".join(map(re.escape, STANDARD_PREFIXES)) + ")"))
    return F.array_distinct(F.filter(import_paths(text), lambda p: F.contains(p, F.lit("/")) & ~standard(p)))


def imported(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id and score 0.3: the first passage of each document that a hit imports and that is not among the hits."""
    paths = small(hits.select(F.explode(imports("text")).alias("imp")).distinct(), 1000)
    found = docs.select("doc_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).join(paths, F.col("path").endswith(F.col("imp")) | F.contains("path", F.concat("imp", F.lit("/"))), "left_semi")
    first = chunks.join(small(found.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min_by("chunk_id", "start_line").alias("chunk_id"))
    return first.join(small(hits.select("chunk_id")), "chunk_id", "left_anti").select("chunk_id", "doc_id", F.lit(0.3).alias("score"))
