"""Postings, frequencies and corpus statistics; differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether any two rows have the same key; only the keys are read and shuffled."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def counted(rows: DataFrame, *columns: str, extra: Column | None = None) -> DataFrame:
    """The columns, and term and tf of each distinct token of every row (and of ``extra``, an array of such pairs).

    All tokens of a passage are in one row, so they are sorted and counted
    there, as runs of equal ones; nothing is shuffled or kept for it.
    """
    s, at = F.col("_sorted"), F.col("_starts")
    rows = rows.select(*columns, F.sort_array("tokens").alias("_sorted"))
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*columns, "_sorted", F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias("_starts"))
    runs = F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("long").alias("tf")))
    return rows.select(*columns, F.inline(runs if extra is None else F.concat(runs, extra)))


def postings(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """term, chunk_id, tf; with ``distinct`` no two passages may have the same id, and nothing is shuffled."""
    if distinct:
        return counted(chunks, "chunk_id").select("term", "chunk_id", "tf")
    return chunks.select(F.explode("tokens").alias("term"), "chunk_id").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def sized_postings(chunks: DataFrame, segments: int | None = None, distinct: bool = False) -> DataFrame:
    """term, chunk_id, tf and dl, the passage's number of tokens.

    With ``segments`` whole passages are dealt to so many partitions by their
    id, before they are counted; with ``distinct`` no two have the same id.
    """
    rows = chunks.select("chunk_id", F.size("tokens").alias("dl"), "tokens")
    rows = index_of(rows.repartition(segments, "chunk_id") if segments else rows)
    return rows if distinct else rows.groupBy("term", "chunk_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "chunk_id", "tf", "dl")


def index_of(rows: DataFrame) -> DataFrame:
    """term, chunk_id, tf and dl of rows with chunk_id, dl and tokens, each counted for itself."""
    return counted(rows, "chunk_id", "dl").select("term", "chunk_id", "tf", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    """Passages that hold each term."""
    return posted.groupBy("term").agg(F.count("*").alias("n_chunks"))


def passages_with(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """The same from the passages; with ``distinct`` no two of them may have the same id, and only counts of terms are shuffled."""
    if distinct:
        return document_frequency(chunks.select(F.explode(F.array_distinct("tokens")).alias("term")))
    return document_frequency(postings(chunks))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.select("term").distinct()


def stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, passages, mean tokens of a passage."""
    size = F.size("tokens") if "tokens" in chunks.columns else F.col("dl")
    return chunks.agg(F.countDistinct("doc_id").alias("total_docs"), F.count("*").alias("total_chunks"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_chunk_len"))


def content_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, passages, bytes, and tokens at four bytes each."""
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    return chunks.agg(F.countDistinct("doc_id").alias("total_docs"), F.count("*").alias("total_chunks"), size.alias("total_bytes"), F.floor(size / 4).alias("total_tokens"))


def incremental_diff(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path and status (skip, update, insert, delete) from path, mod_time of both sides; times count in whole seconds."""
    a = stored.select("path", F.unix_timestamp("mod_time").alias("old"))
    b = found.select("path", F.unix_timestamp("mod_time").alias("new"))
    status = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") >= F.col("new"), "skip").otherwise("update")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def changed(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored documents that are gone or older than their files; new files are not looked for."""
    return incremental_diff(stored, found).where("status in ('delete', 'update')")


def without(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table without the rows of deleted keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)
