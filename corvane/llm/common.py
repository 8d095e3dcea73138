"""What the operators share: tables, the shared scratch folder, bounded memos."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import weakref
from itertools import chain, filterfalse

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.corpus import spread

#: Rows and bytes of one Arrow batch sent to Python: very long texts make a
#: batch close early instead of growing with the row count.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, over all cores even if its files make fewer splits (a small table in one row group)."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the master is local (tests) is a
    folder of this process made, and then kept for the session; on a cluster,
    whose executors would each write to a disk of their own, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.corvane.scratch", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.corvane.scratch", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage that outlives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Memo(dict):
    """Results by key, for one Python worker.

    ``fill`` computes what a batch needs and lacks, in one call; above
    ``limit`` entries only those of the batch at hand are kept, so memory is
    bounded whatever the vocabulary of the corpus.  A worker serves one stage
    after the other: memos of another ``use`` are emptied when one is filled.
    """

    live: weakref.WeakValueDictionary = weakref.WeakValueDictionary()

    def __init__(self, compute, limit: int, use: str):
        super().__init__()
        self.compute, self.limit, self.use = compute, limit, use
        Memo.live[id(self)] = self

    def fill(self, *batches) -> None:
        """Make sure that every key of the given collections of keys is there."""
        for other in list(Memo.live.values()):
            if other.use != self.use:
                other.clear()
        missing = set(filterfalse(self.__contains__, chain.from_iterable(batches)))
        if len(self) + len(missing) > self.limit:
            held = {k: self[k] for k in set().union(*batches) - missing}
            self.clear()
            self.update(held)
        if missing:
            keys = list(missing)
            with calm():
                self.update(zip(keys, self.compute(keys), strict=True))


@contextlib.contextmanager
def calm():
    """No cycle collection inside: batches of many small lists would set it off again and again, with nothing to find."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
