"""Token ids in seekable Zstandard files.

A file is a run of independent Zstandard frames, one for each document, each
with a content checksum; then a skippable frame with the doc_ids; then, last,
the seek table of the Zstandard seekable format (compressed size,
decompressed size and checksum of every frame, and a footer that gives the
number of frames).  A reader takes the footer, the table and the ids, and
decompresses the frames of the documents asked for and no others.  Any
Zstandard decoder also reads a whole file as one stream.

Defined results: a null text is an empty one (only the end id is written); a
null doc_id sorts first; rows that repeat a doc_id are kept, ordered by text;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import Memo, scratch, table, tune

SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
END_ID = 2
LEVEL = 3
#: A doc_id that stands for null inside the files.
NO_ID = -(1 << 63)


# --- the file format --------------------------------------------------------


class FrameWriter:
    """Writes one file of frames to a binary sink."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.entries, self.ids = sink, [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.pack.compress(ids)
        self.sink.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        ids = np.asarray(self.ids, "<i8").tobytes()
        seek = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(seek)) + seek)


class FrameReader:
    """Random access to a file of frames: ``source`` needs seek, read and tell."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n
        source.seek(start - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        source.seek(start - 16 - 8 * n)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_IDS, 8 * n):
            raise ValueError("the frame of doc_ids is damaged")
        self.doc_ids = np.frombuffer(source.read(8 * n), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        """The ids of the i-th document as bytes; both checksums are tested."""
        import xxhash

        self.source.seek(int(self.starts[i]))
        size, raw, check = map(int, self.entries[i])
        ids = self.unpack.decompress(self.source.read(size), max_output_size=raw)
        if len(ids) != raw or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return ids

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of one document, found in the sorted doc_ids."""
        i = int(np.searchsorted(self.doc_ids, doc_id))
        if i == len(self.doc_ids) or self.doc_ids[i] != doc_id:
            raise KeyError(doc_id)
        return np.frombuffer(self.frame(i), "<u4")


# --- encoding ---------------------------------------------------------------

_PLAIN = re.compile(r"[ -~\t\n\v\f\rÀ-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_ODD = re.compile(r"[\x1c-\x1f]")


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


#: Settings that the cuts below are right for; a file with any others is encoded by whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """The ``tokenizers`` library's ids of whole texts, one call for each distinct piece.

    Where the file's normalizer and pre-tokenizer are those above, texts are
    cut; with any others the library gets whole texts.  The former replaces runs of white space by one and lets no token cross
    it nor the cuts of its pattern, so a text's ids are those of its pieces in
    turn.  A text of ASCII and precomposed Latin-1 letters is cut as the
    tokenizer's own pattern cuts it (normal form and lower-casing are plain
    there).  Other texts are cut at white space and their words sent to the
    library as they are; a text with the separators that Python but not the
    tokenizer takes for white space goes to it whole.
    """

    def __init__(self, path: str, pieces: int = 900_000, words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.known = made.get("normalizer") == _NORMALIZER and made.get("pre_tokenizer") == _CUTS
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = Memo(lambda p: self._run(self.bare, p), pieces, "token ids")
        self.words = Memo(lambda w: self._run(self.full, w), words, "token ids")

    @staticmethod
    def _run(tokenizer, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.known:
            return self._run(self.full, texts)
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        cut = [_PIECE.findall(t.lower()) if p else None if _ODD.search(t) else t.split() for t, p in zip(texts, plain, strict=True)]
        self.pieces.fill(*[c for c, p in zip(cut, plain, strict=True) if p])
        self.words.fill(*[c for c, p in zip(cut, plain, strict=True) if not p and c is not None])
        piece, word = self.pieces.__getitem__, self.words.__getitem__
        return [self._run(self.full, [t])[0] if c is None else b"".join(map(piece if p else word, c)) for t, c, p in zip(texts, cut, plain, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and tokenizer file."""
    return WordEncoder(path)


# --- the operator -----------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_part(batches, out: str, path: str, end_id: int):
    """One task: its documents, already in order, become one file."""
    context = TaskContext.get()
    name = f"part-{context.partitionId():06d}.zst"
    sink = writer = None
    first, total, last_bytes = None, 0, struct.pack("<I", end_id)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts), strict=True):
            if writer is None:
                files, folder = _open(out)
                files.create_dir(folder, recursive=True)
                # Each attempt writes its own file and then moves it into place; attempts of a task hold the same bytes.
                partial = f"{folder}/_{name}.{context.taskAttemptId()}"
                sink = files.open_output_stream(partial)
                writer, first = FrameWriter(sink), doc_id
            ids += last_bytes
            writer.add(doc_id, ids)
            total += len(ids) // 4
    if writer is not None:
        writer.close()
        sink.close()
        files.move(partial, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [f"{out}/{name}"], "n_docs": [len(writer.ids)], "n_ids": [total]}, _FILES)


_FILES = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> list:
    """Encode ``doc_id, text`` and write the files below ``out`` in ascending doc_id order.

    Returns one small row for each file (never for each document), ordered:
    part, file, n_docs, n_ids and start, the number of ids before the file.
    """
    tune(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(lambda it: _write_part(it, out, tokenizer, end_id), "part long, file string, n_docs long, n_ids long").collect()
    found, start = [], 0
    for row in sorted(files):
        found.append({**row.asDict(), "start": start})
        start += row["n_ids"]
    return found


def _read_part(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            files, path = _open(row["file"])
            with files.open_input_file(path) as source:
                reader, at = FrameReader(source), row["start"]
                out, held = [], 0
                for i, doc_id in enumerate(reader.doc_ids.tolist()):
                    ids = reader.frame(i)
                    out.append((None if doc_id == NO_ID else doc_id, at, len(ids) // 4, ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document in the files that ``write_token_files`` lists."""
    tune(spark)
    rows = [(f["file"], f["start"]) for f in files]
    listed = spark.createDataFrame(rows, "file string, start long")
    if rows:
        listed = listed.repartition(len(rows), "file")
    return listed.mapInArrow(_read_part, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to files, read them back, and give their place and checksum."""
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
