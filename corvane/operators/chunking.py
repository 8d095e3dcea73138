"""Documents to passages of bounded size."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import stem, text as tx

SPANS = "array<struct<first:int,end:int>>"


def greedy_spans(counts: list[int], most: int, overlap: int, closed: bool = True) -> list[tuple[int, int]]:
    """Half-open line spans of at most ``most`` tokens, each at least one line.

    The next span steps back over whole lines until ``overlap`` tokens are
    covered, but always moves on by one line; so the spans after the one that
    reaches the end are its ever shorter suffixes.  ``closed`` limits the next
    start to the end of the span before.
    """
    spans, first, n = [], 0, len(counts)
    while first < n:
        end, total = first, 0
        while end < n and not (total and total + counts[end] > most):
            total += counts[end]
            end += 1
        end = max(end, first + 1)
        spans.append((first, end))
        back = covered = 0
        while overlap and covered < overlap and end - back > first:
            back += 1
            covered += counts[end - back]
        first = max(end - back, first + 1)
        if closed:
            first = min(first, end)
    return spans


def span_arrays(counts: pa.Array, most: int, overlap: int) -> pa.Array:
    """Greedy spans of every list of counts; one list at a time is a list of Python numbers, the rest stays in packed arrays."""
    first, end, offsets = array("i"), array("i"), array("i", [0])
    for row in counts:
        for a, b in greedy_spans(row.values.to_pylist(), most, overlap):
            first.append(a)
            end.append(b)
        offsets.append(len(first))
    ints = lambda values: pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32())
    return pa.ListArray.from_arrays(ints(offsets), pa.StructArray.from_arrays([ints(first), ints(end)], ["first", "end"]))


def spans(counts: Column, most: int, overlap: int) -> Column:
    """Greedy spans of an array of token counts of lines; only the counts travel to Python."""

    @F.arrow_udf(SPANS)
    def run(column: pa.Array) -> pa.Array:
        return span_arrays(column, most, overlap)

    return run(counts)


def line_chunks(docs: DataFrame, most: int = 512, overlap: int = 50, stemming: bool = False, drop_suffixes: bool = False) -> DataFrame:
    """chunk_id, doc_id, start_line, end_line, tokens and text of the passages of every document.

    Blank lines before the first text of a passage are in its range but not in
    its text.  ``drop_suffixes`` leaves out passages inside the one before.
    """
    kept = [c for c in ("num", "path", "mod_time", "lang") if c in docs.columns]
    rows = docs.select("doc_id", *kept, tx.lines_of("text").alias("lines"))
    rows = rows.withColumn("spans", spans(F.transform("lines", tx.count_tokens), most, overlap))
    if drop_suffixes:
        rows = rows.withColumn("spans", F.filter("spans", lambda s, i: (i == 0) | (F.get(F.col("spans"), F.greatest(i - 1, F.lit(0)))["end"] < s["end"])))
    rows = rows.select("doc_id", *kept, "lines", F.explode("spans").alias("s"))
    joined = F.array_join(F.slice("lines", F.col("s.first") + 1, F.col("s.end") - F.col("s.first")), "\n")
    out = rows.select(
        tx.line_chunk_id("doc_id", "s.first", "s.end").alias("chunk_id"),
        "doc_id",
        *kept,
        (F.col("s.first") + 1).alias("start_line"),
        F.col("s.end").alias("end_line"),
        F.regexp_replace(joined, "^\n+", "").alias("text"),
    )
    return with_tokens(out, stemming)


def with_tokens(chunks: DataFrame, stemming: bool = False) -> DataFrame:
    tokens = tx.tokenize("text")
    return chunks.withColumn("tokens", stem.stem_tokens(tokens) if stemming else tokens)


def whole_documents(docs: DataFrame, stemming: bool = False) -> DataFrame:
    """Every document as one passage."""
    kept = [c for c in ("num", "path", "mod_time", "lang") if c in docs.columns]
    out = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", *kept, F.lit(1).alias("start_line"), F.size(tx.lines_of("text")).alias("end_line"), "text")
    return with_tokens(out, stemming)


def composite_chunks(docs: DataFrame, most: int = 512, overlap: int = 50, stemming: bool = False) -> DataFrame:
    """Go documents by declarations, all others (and Go without any) by lines."""
    from corvane.operators.golang import unit_chunks

    units = unit_chunks(docs.where("lang = 'go'"), most, overlap, stemming)
    rest = docs.join(units.select("doc_id").distinct(), "doc_id", "left_anti")
    return line_chunks(rest, most, overlap, stemming).unionByName(units, allowMissingColumns=True)
