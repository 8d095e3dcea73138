"""Passages into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import text as tx


def utility(candidates: DataFrame, boost: float = 0.1) -> DataFrame:
    """Candidates (query_id, chunk_id, score, text, mod_time, ...) with n_tokens and utility.

    Age counts from the newest candidate of the query, up to 30 days.
    """
    newest = F.max("mod_time").over(Window.partitionBy("query_id"))
    age = F.least(F.lit(1.0), (F.unix_timestamp(newest) - F.unix_timestamp("mod_time")) / F.lit(86400.0) / 30)
    recency = F.lit(1.0) if not boost else F.coalesce(1 + boost * (1 - age) - boost * age, F.lit(1.0))
    rows = candidates.withColumn("n_tokens", F.greatest(tx.count_tokens("text"), F.lit(1)))
    return rows.withColumn("utility", F.col("score") * recency / F.col("n_tokens"))


def greedy(candidates: DataFrame, budget: int) -> DataFrame:
    """The candidates that fit one after the other by utility; one that does not is passed over.

    A query's candidates are a bounded top list; the choice is a fold over
    their sorted sizes.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("utility")).alias("u"), "chunk_id", "n_tokens")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(s, x):
        fits = s["used"] + x["n_tokens"] <= budget
        return F.struct(F.when(fits, s["used"] + x["n_tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["chunk_id"]))).otherwise(s["ids"]).alias("ids"))

    picked = candidates.groupBy("query_id").agg(items.alias("items")).select("query_id", F.explode(F.aggregate("items", start, step, lambda s: s["ids"])).alias("chunk_id"))
    return candidates.join(picked, ["query_id", "chunk_id"], "left_semi")


def merge_adjacent(rows: DataFrame) -> DataFrame:
    """query_id, doc_id, start_line, end_line, score and text of touching or overlapping passages as one.

    Texts are joined by line feeds; lines that overlap stay twice.
    """
    per = Window.partitionBy("query_id", "doc_id").orderBy("start_line", "end_line", "chunk_id")
    reach = F.max("end_line").over(per.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chunk_id", "text")))
    return marked.groupBy("query_id", "doc_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text")).drop("island")


def snippets(merged: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, rank, path, range, why, text and used, in order of score; passages of unknown documents are dropped."""
    rows = merged.join(docs.select("doc_id", "path"), "doc_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line"))
    return rows.select("query_id", place.alias("rank"), "path", tx.line_range("start_line", "end_line").alias("range"), tx.why("score").alias("why"), "text", tx.count_tokens("text").alias("used"))


def packed_context(queries: DataFrame, candidates: DataFrame, docs: DataFrame, budget: int = 4000, boost: float = 0.1) -> DataFrame:
    """One row for each query: query, budget_tokens, used_tokens, snippets; also for those without candidates."""
    chosen = greedy(utility(candidates, boost), budget)
    found = snippets(merge_adjacent(chosen), docs)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "path", "range", "why", "text")))
    packed = found.groupBy("query_id").agg(F.sum("used").alias("used"), F.transform(ordered, lambda s: s.dropFields("rank")).alias("found"))
    empty = F.array().cast("array<struct<path:string,range:string,why:string,text:string>>")
    return queries.join(packed, "query_id", "left").select("query_id", F.col("text").alias("query"), F.lit(budget).alias("budget_tokens"), F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("found", empty).alias("snippets"))


def context_json(packed: DataFrame) -> DataFrame:
    return packed.select("query_id", F.to_json(F.struct("query", "budget_tokens", "used_tokens", "snippets"), {"pretty": "true"}).alias("json"))


def context_text(packed: DataFrame) -> DataFrame:
    """Snippets as blocks headed by path and range."""
    blocks = F.transform("snippets", lambda s: F.concat(F.lit("=== "), s["path"], F.lit(":"), s["range"], F.lit(" ===\n"), s["text"], F.lit("\n\n")))
    return packed.select("query_id", F.array_join(blocks, "").alias("context"))


BUILDER = """You prepare context for a question about a body of text.

Question: {query}

Passages found:
{snippets}

Say which passages answer the question, what is missing, and which further searches would help."""
RUNTIME = """Answer from the passages below and nothing else; give the path and lines of each statement.

Question: {query}

Passages:
{snippets}"""


def prompts(packed: DataFrame, template: str = "runtime", question: str | None = None) -> DataFrame:
    """The builder or runtime prompt of each packed context; ``question`` replaces the query."""
    head, _, rest = {"builder": BUILDER, "runtime": RUNTIME}[template].partition("{query}")
    middle, _, tail = rest.partition("{snippets}")
    parts = F.transform("snippets", lambda s: F.concat(F.lit("- "), s["path"], F.lit(" "), s["range"], F.lit("\n"), s["text"]))
    asked = F.lit(question) if question is not None else F.col("query")
    return packed.select("query_id", F.concat(F.lit(head), asked, F.lit(middle), F.array_join(parts, "\n\n"), F.lit(tail)).alias("prompt"))
