"""Tables as a corpus of documents: doc_id, path, text, mod_time, lang."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files make fewer splits than there are cores (a table in one row group).

    Larger tables have more splits than that and pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spread(table(spark, sf_dir, "documents"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with made-up paths and modification times; ``num`` is its own doc_id."""
    docs = texts(spark, sf_dir)
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return docs.select(
        F.col("doc_id").alias("num"),
        path.alias("path"),
        F.coalesce("text", F.lit("")).alias("text"),
        (start + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))).alias("mod_time"),
    ).select("num", tx.doc_id("path").alias("doc_id"), "path", "text", "mod_time", tx.detect_language("path").alias("lang"))


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Named contents as documents of language 'text'."""
    rows = spark.createDataFrame(list(files.items()), "path string, text string")
    return rows.select(tx.doc_id("path").alias("doc_id"), "path", "text", F.current_timestamp().alias("mod_time"), F.lit("text").alias("lang"))
