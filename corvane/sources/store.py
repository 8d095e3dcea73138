"""The stored index: Parquet parts in one folder, and a manifest.

A table is a list of parts.  A change writes small new parts and, for what it
takes away, a part of ids that are gone; a row is hidden if its id went later
than it came.  When a table has many parts they are rewritten as one.  The
manifest names the parts and is replaced last, by a rename, so readers see
either the old or the new state and a lost writer leaves only unused folders,
which the next change removes; what the state before named stays for readers
that still hold it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.config import Config
from corvane.operators import index

VERSION = 3
TABLES = ("docs", "chunks", "postings", "vectors", "symbols", "calls")
#: The id that takes a table's rows away, and the kinds of gone ids that hold for it.
KEYS = {"docs": "doc_id", "chunks": "doc_id", "symbols": "doc_id", "calls": "doc_id", "postings": "chunk_id", "vectors": "id"}
KINDS = {"doc_id": ["doc"], "chunk_id": ["chunk"], "id": ["chunk", "vector"]}
#: A table of more parts than this is rewritten as one.
MOST_PARTS = 8
#: Postings of a segment: what one task sorts in memory; and those worth a task of their own while cores are idle.
SEGMENT, SMALL_SEGMENT = 3_000_000, 250_000
#: More bytes of gone ids than this are not broadcast.
MOST_GONE = 8 << 20
EMPTY = {"version": 0, "config_hash": "", "seq": 0, "tables": {}, "gone": [], "before": []}


@dataclass(frozen=True)
class Migration:
    needs_migration: bool
    needs_rebuild: bool
    old: int
    new: int
    reason: str


class Store:
    """Tables below ``path``, which may be in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifest

    def _file(self, name: str):
        """A path and its file system."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The current state, read without a Spark job."""
        path, files = self._file("manifest.json")
        if not files.exists(path):
            return json.loads(json.dumps(EMPTY))
        source = files.open(path)
        try:
            return EMPTY | json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def save_manifest(self, manifest: dict) -> None:
        """Write the state beside the current one and move it into its place."""
        jvm = self.spark._jvm
        fresh, files = self._file(f".manifest-{uuid.uuid4().hex}")
        out = files.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        path, _ = self._file("manifest.json")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(fresh), files.makeQualified(path), options)

    @staticmethod
    def _parts(manifest: dict) -> list[str]:
        return [p for entries in (*manifest["tables"].values(), manifest["gone"]) for p, _ in entries]

    def _replace(self, old: dict, new: dict) -> None:
        """Put the new state in place of the old one and remove the parts that neither names."""
        new["before"] = self._parts(old)
        self.save_manifest(new)
        kept = {*new["before"], *self._parts(new)}
        root, files = self._file("")
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if status.isDirectory() and name.rpartition("-")[0] in (*TABLES, "gone") and name not in kept:
                files.delete(status.getPath(), True)

    def check(self, config: Config) -> Migration:
        """Whether the stored index fits the version and settings."""
        m = self.manifest()
        old = m["version"]
        if old > VERSION:
            return Migration(False, True, old, VERSION, f"made by a newer version ({old} > {VERSION})")
        if m["config_hash"] and m["config_hash"] != config.index_hash():
            return Migration(old < VERSION, True, old, VERSION, "the index settings changed")
        if 0 < old < VERSION:  # tables were laid out otherwise
            return Migration(True, True, old, VERSION, f"version {old} to {VERSION}")
        return Migration(old < VERSION, False, old, VERSION, "a new index" if old == 0 else "")

    # -- tables

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def _load(self, entries: list, seq: bool) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.path}/{p}").select("*", *([F.lit(n).alias("_seq")] if seq else [])) for p, n in entries]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as the manifest has it."""
        manifest = manifest or self.manifest()
        entries = manifest["tables"][name]
        later = [g for g in manifest["gone"] if g[1] > min(n for _, n in entries)]
        if not later:
            return self._load(entries, False)
        key = KEYS[name]
        # a table that is larger than its gone ids by far is shuffled, but not sorted
        hint = (lambda df: df.hint("shuffle_hash")) if self._bytes(later) > MOST_GONE else (lambda df: df)
        if max(n for _, n in entries) < min(n for _, n in later):  # all ids went after all rows came
            gone = self._load(later, False).where(F.col("kind").isin(KINDS[key])).select(F.col("id").alias("_id")).distinct()
            return self._load(entries, False).join(hint(gone), F.col(key) == F.col("_id"), "left_anti")
        gone = self._load(later, True).where(F.col("kind").isin(KINDS[key])).groupBy("id").agg(F.max("_seq").alias("_gone")).withColumnRenamed("id", "_id")
        rows = self._load(entries, True)
        return rows.join(hint(gone), (F.col(key) == F.col("_id")) & (F.col("_gone") > F.col("_seq")), "left_anti").drop("_seq")

    def _bytes(self, entries: list) -> int:
        """Bytes of the files of parts."""
        return sum(files.getContentSummary(path).getLength() for path, files in (self._file(p) for p, _ in entries))

    def segments(self, n: int) -> int:
        """Segments for so many postings."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(-(-n // SEGMENT), min(cores, -(-n // SMALL_SEGMENT)), 1)

    def put(self, name: str, df: DataFrame) -> str:
        """Write rows as a part that no manifest names yet.

        Postings are laid out in segments, each of the whole passages whose id
        falls to it and sorted by term: a few terms read a few pages of each.
        """
        if name == "postings":
            return self._put(name, self._sorted(df.repartition(self.segments(df.count()), "chunk_id")))
        return self._put(name, df)

    def put_postings(self, chunks: DataFrame) -> str:
        """The postings of passages (chunk_id, dl, tokens) as a part: passages are dealt to segments before they are counted, so each is shuffled once, as an array."""
        n = chunks.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        return self._put("postings", self._sorted(index.sized_postings(chunks, self.segments(n), not index.repeats(chunks, "chunk_id"))))

    @staticmethod
    def _sorted(postings: DataFrame) -> DataFrame:
        return postings.sortWithinPartitions("term", "chunk_id")

    def _put(self, name: str, df: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def part(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def commit(self, config: Config, parts: dict[str, str], gone: DataFrame | None = None, replace: bool = False) -> None:
        """Make parts visible, all at once: added to their tables (or instead of them), after the ids (kind, id) of ``gone`` went."""
        old = self.manifest()
        new = json.loads(json.dumps(old)) | {"version": VERSION, "config_hash": config.index_hash(), "seq": old["seq"] + 1}
        if gone is not None:
            new["gone"].append([self.put("gone", gone), new["seq"]])
        for name, part in parts.items():
            new["tables"][name] = ([] if replace else new["tables"].get(name, [])) + [[part, new["seq"]]]
        for name, entries in new["tables"].items():
            if len(entries) > MOST_PARTS:
                new["tables"][name] = [[self.put(name, self.read(name, new)), new["seq"]]]
        first = min((n for entries in new["tables"].values() for _, n in entries), default=0)
        new["gone"] = [g for g in new["gone"] if g[1] > first]
        if len(new["gone"]) > MOST_PARTS:  # few parts of ids are enough for tables that change seldom
            new["tables"] = {name: [[self.put(name, self.read(name, new)), new["seq"]]] for name in new["tables"]}
            new["gone"] = []
        self._replace(old, new)

    def write(self, config: Config, **tables: DataFrame) -> None:
        """The given tables as a whole, in place of what they were."""
        self.commit(config, {name: self.put(name, df) for name, df in tables.items()}, replace=True)

    def clear(self) -> None:
        """An index without tables."""
        old = self.manifest()
        self._replace(old, json.loads(json.dumps(EMPTY)) | {"seq": old["seq"]})

    # -- lookups

    def doc(self, doc_id: str):
        """One document, or KeyError."""
        return self._one("docs", F.col("doc_id") == doc_id, doc_id)

    def chunk(self, chunk_id: str):
        return self._one("chunks", F.col("chunk_id") == chunk_id, chunk_id)

    def symbol(self, symbol_id: str):
        return self._one("symbols", F.col("id") == symbol_id, symbol_id)

    def _one(self, name: str, wanted: Column, value: str):
        rows = self.read(name).where(wanted).limit(1).collect()
        if not rows:
            raise KeyError(value)
        return rows[0]

    def doc_chunks(self, doc_id: str) -> DataFrame:
        return self.read("chunks").where(F.col("doc_id") == doc_id).orderBy("start_line")

    def doc_symbols(self, doc_id: str) -> DataFrame:
        return self.read("symbols").where(F.col("doc_id") == doc_id)

    def doc_calls(self, doc_id: str) -> DataFrame:
        return self.read("calls").where(F.col("doc_id") == doc_id)

    def term_postings(self, *terms: str) -> DataFrame:
        return self.read("postings").where(F.col("term").isin(*terms))

    # -- changes

    def gone_with(self, docs: DataFrame) -> DataFrame:
        """The ids (kind, id) of documents (doc_id) and of their stored passages."""
        ids = docs.select("doc_id").distinct()
        chunks = self.read("chunks").join(ids, "doc_id", "left_semi").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
        return ids.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")).unionByName(chunks)

    def upsert_vectors(self, config: Config, rows: DataFrame) -> None:
        """Vectors (id, vector, metadata) in place of those with the same ids; all must have the stored dimension."""
        part = self.put("vectors", rows)
        rows = self.part(part)
        dims = {r[0] for r in rows.select(F.size("vector")).distinct().limit(3).collect()}
        known = self.has("vectors")
        if known:
            dims |= {r[0] for r in self.read("vectors").select(F.size("vector")).limit(1).collect()}
        if len(dims) > 1:
            raise ValueError(f"vectors of different dimensions: {sorted(dims)}")
        self.commit(config, {"vectors": part}, rows.select(F.lit("vector").alias("kind"), "id").distinct() if known else None)

    def delete_docs(self, config: Config, gone: DataFrame) -> None:
        """Remove documents (doc_id) and all that belongs to them."""
        self.commit(config, {}, self.gone_with(gone))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; on a local master without it, below the machine's temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.gettempdir()
    return f"{folder.rstrip('/')}/corvane-{what}-{uuid.uuid4().hex}"
