"""Continuous indexing of a folder of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import text as tx
from corvane.plans.engine import Engine

SCHEMA = "path string, text string, mod_time timestamp"


def watch(spark: SparkSession, folder: str, engine: Engine, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index new Parquet files of (path, text, mod_time) below ``folder`` as they come.

    A batch adds and replaces documents; the latest row of a path wins, and a
    row older than what is stored is passed over.  Only what a batch brings is
    written, and becomes visible at its end, so a batch that runs again after a
    failure ends in the same state.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mod_time"), "text"))
        rows = batch.withColumn("n", last).where("n = 1").drop("n")
        engine.index(rows.withColumns({"doc_id": tx.doc_id("path"), "lang": tx.detect_language("path")}), whole=False)

    reader = spark.readStream.schema(SCHEMA).parquet(folder)
    writer = reader.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
