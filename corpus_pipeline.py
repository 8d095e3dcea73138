"""A training-data pipeline: toxicity, near-duplicates, source mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a table that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``.

Defined results: a null text is an empty one and stays through all stages, as
do rows without doc_id, which are compared by their texts; rows that repeat
both doc_id and text are one from the second stage on, different texts of one
doc_id are documents of their own; a null source is a source; a text of any
length is read whole; further columns, whatever their names, pass through to
the last stage, which returns doc_id and ids alone; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, near_dup, pieces, toxicity
from corvane.llm.common import scratch, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, learnt from the labelled ones, does not reject."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return near_dup.drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson count towards the target weights of their sources, in global random order."""
    return mixing.mix_sources(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked by decoding them."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", clean), ("near_duplicates", dedupe), ("mixing", mix), ("sentencepiece", encode)]

#: Neither the field, nor the sketches, nor the segmentation can be said in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
