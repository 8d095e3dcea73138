"""Symbols, comments and calls in source code."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import text as tx
from corvane.operators import expand

SYMBOLS = "id string, name string, type string, doc_id string, line int, signature string"


# --- symbols by the beginnings of lines -------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Lines that start with ``prefix``: the name ends before the first of ``ends`` that is found, tried in turn."""

    prefix: str
    kind: str
    ends: str
    whole: bool = False  # without an end the whole rest is the name

    def name(self, line: Column) -> Column:
        """The name in a line, null if there is none."""
        start = "^" + re.escape(self.prefix)
        tries = [f"{start}([^{re.escape(e)}]+){re.escape(e)}" for e in self.ends] + [f"{start}(.*)$"] * self.whole
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(line, t, 1)), F.lit("")) for t in tries])


# How lines of a language begin that declare something.
_SCRIPT = [Rule("function ", "function", "("), Rule("class ", "class", " {", True), Rule("const ", "constant", " ="), Rule("let ", "variable", " =")]
RULES = {
    "python": [Rule("def ", "function", "("), Rule("class ", "class", "(:")],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": [Rule("public class ", "class", " {<", True), Rule("private class ", "class", " {<", True), Rule("class ", "class", " {<", True), Rule("public interface ", "interface", " {<", True), Rule("interface ", "interface", " {<", True)],
}


def prefix_symbols(docs: DataFrame) -> DataFrame:
    """Symbols of Python, JavaScript, TypeScript and Java documents (doc_id, text, lang), by the first rule that fits a trimmed line."""
    rows = docs.where(F.col("lang").isin(*RULES)).select("doc_id", "lang", F.posexplode(tx.lines_of("text")).alias("at", "raw"))
    rows = rows.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    found = []
    for kind in dict.fromkeys(tuple(rules) for rules in map(tuple, RULES.values())):
        here = F.col("lang").isin(*[g for g, rules in RULES.items() if tuple(rules) == kind])
        found += [F.when(here, F.struct(rule.name(F.col("line")).alias("name"), F.lit(rule.kind).alias("type"))) for rule in kind]
    named = F.filter(F.array(*found), lambda s: s["name"].isNotNull())
    rows = rows.withColumn("s", F.get(named, F.lit(0))).where("s is not null")
    number = F.col("at") + 1
    return rows.select(tx.symbol_id("doc_id", "s.name", number).alias("id"), "s.name", "s.type", "doc_id", number.alias("line"), F.col("line").alias("signature"))


# --- comments ---------------------------------------------------------------------

# Marks of comments by language, and words that make a line comment a document comment.
SLASHES = {"line": "//", "open": r"/\*", "close": r"\*/"}
HASHES = {"line": "#", "open": None, "close": None}
COMMENTS = {
    "go": SLASHES,
    "python": {"line": "#", "open": r"^\s*(?:'''|\"\"\")(.*)$", "close": r"(?:'''|\"\"\")$"},
    "javascript": SLASHES,
    "typescript": SLASHES,
    "java": SLASHES,
    "c": SLASHES,
    "cpp": SLASHES,
    "rust": SLASHES,
    "ruby": {"line": "#", "open": "^=begin", "close": "^=end"},
    "shell": HASHES,
}
NOTES = "TODO|FIXME|NOTE|BUG|HACK|XXX|REVIEW|OPTIMIZE"


def find_comments(text: str, lang: str) -> list[dict]:
    """Comments of one source text: blocks, notes (type doc) and lines, consecutive lines as one."""
    marks = COMMENTS.get(lang, COMMENTS["go"])
    opens, closes = (re.compile(marks[k]) if marks[k] else None for k in ("open", "close"))
    plain = re.compile(rf"^\s*{marks['line']}(.*)$")
    noted = re.compile(r"^\s*///?\s*(.*)$" if lang == "rust" else rf"^\s*{marks['line']}\s*(?:{NOTES}):?\s*(.*)$")
    found: list[dict] = []
    block: list[str] | None = None

    def add(kind, text, first, last):
        found.append({"type": kind, "text": text, "start_line": first, "end_line": last})

    for n, line in enumerate((text or "").split("\n"), 1):
        if block is not None:
            block.append(line)
            if closes.search(line):
                add("block", "\n".join(block).strip(), n - len(block) + 1, n)
                block = None
        elif opens and (start := opens.search(line)):
            end = closes.search(line)
            if not end:
                block = [line]
            elif start.end() < end.start() and (inner := line[start.end() : end.start()].strip()):
                add("block", inner, n, n)
        elif noted.match(line):
            add("doc", line.strip(), n, n)
        elif (m := plain.match(line)) and (inner := m[1].strip()):
            last = found[-1] if found else None
            if last and last["type"] == "line" and last["end_line"] == n - 1:
                last.update(text=f"{last['text']}\n{inner}", end_line=n)
            else:
                add("line", inner, n, n)
    return found


COMMENT = "array<struct<type:string,text:string,start_line:int,end_line:int>>"


def comments(docs: DataFrame) -> DataFrame:
    """doc_id, type, text, start_line and end_line of all comments."""

    @F.pandas_udf(COMMENT)
    def found(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([find_comments(t, g) for t, g in zip(texts, langs)])

    return docs.select("doc_id", F.inline(found("text", "lang"))).select("doc_id", "type", "text", "start_line", "end_line")


def comment_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, term and n: how often each token occurs in a document's comments."""
    return comments(docs).select("doc_id", F.explode(tx.tokenize("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


# --- calls ------------------------------------------------------------------------


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, caller_id, callee_id and line of raw calls (doc_id, caller, caller_line, callee, line).

    A caller is a known function of the same document or named after its own
    place; a callee is a known function or stays a name.
    """
    known = symbols.where("type in ('function', 'method')")
    latest = known.groupBy("name").agg(F.max_by(F.struct("id", "doc_id"), F.struct("doc_id", "line")).alias("s"))
    names = latest.select("name", F.col("s.id").alias("known_id"), F.col("s.doc_id").alias("known_doc"))
    rows = calls.join(names.withColumnRenamed("name", "callee"), "callee", "left").withColumn("callee_id", F.coalesce("known_id", "callee")).drop("known_id", "known_doc")
    rows = rows.join(names.withColumnRenamed("name", "caller"), "caller", "left")
    own = F.when(F.col("known_doc") == F.col("doc_id"), F.col("known_id"))
    return rows.select("doc_id", F.coalesce(own, tx.symbol_id("doc_id", "caller", "caller_line")).alias("caller_id"), "callee_id", "line")


def callers(calls: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """of_id and the distinct known symbols that call it, one step away."""
    edges = calls.join(of.select(F.col("id").alias("callee_id")), "callee_id").select(F.col("callee_id").alias("of_id"), F.col("caller_id").alias("id")).distinct()
    return edges.join(symbols, "id")


def callees(calls: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """of_id and the distinct known symbols that it calls, one step away."""
    edges = calls.join(of.select(F.col("id").alias("caller_id")), "caller_id").select(F.col("caller_id").alias("of_id"), F.col("callee_id").alias("id")).distinct()
    return edges.join(symbols, "id")


def chunk_metadata(chunks: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """chunk_id with type, name, signature, symbols, calls, called_by and imports of its first symbol and text."""
    inside = chunks.select("chunk_id", "doc_id", "start_line", "end_line").join(symbols, "doc_id").where("line between start_line and end_line")
    listed = F.array_sort(F.collect_list(F.struct("line", "id", "name", "type", "signature")))
    found = inside.groupBy("chunk_id").agg(listed.alias("s"))
    first = found.select("chunk_id", F.transform("s", lambda x: x["id"]).alias("symbols"), F.element_at("s", 1).alias("p"))
    rows = chunks.select("chunk_id", "text").join(first, "chunk_id", "left")
    # Passages without a function have a key of their own, so that they do not all meet as nulls.
    known = F.col("p.type").isin("function", "method")
    rows = rows.withColumn("pid", F.when(known, F.col("p.id")).otherwise(F.concat(F.lit("-"), "chunk_id")))
    # Only calls of and to these functions are gathered, not those to the names that everyone calls.
    asked = rows.where(known).select("pid").distinct()
    of = lambda side: calls.withColumn("pid", F.col(side)).join(asked, "pid", "left_semi").groupBy("pid")
    out = of("caller_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "callee_id"))), lambda x: x["callee_id"]).alias("calls"))
    into = of("callee_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "caller_id"))), lambda x: x["caller_id"]).alias("called_by"))
    rows = rows.join(out, "pid", "left").join(into, "pid", "left")
    kind = F.when(F.col("p.type").isin("function", "method"), "function").when(F.col("p.type").isin("interface", "struct", "type", "class"), F.col("p.type")).otherwise("mixed")
    none = F.array().cast("array<string>")
    paths = F.when(F.col("p").isNotNull() & F.contains("text", F.lit("import")), expand.import_paths("text")).otherwise(none)
    return rows.select("chunk_id", kind.alias("type"), F.col("p.name").alias("name"), F.col("p.signature").alias("signature"), F.coalesce("symbols", none).alias("symbols"), F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"), paths.alias("imports"))
