"""Token counts without tokenizing what needs no merging.

A SentencePiece text is cut where no piece of the vocabulary can cross: before
a run of spaces, and around a line feed.  That no piece has a space mark after
another character, nor a line feed, is tested on the vocabulary itself
(``prove``), as is, for every vocabulary string that begins with the space
mark, that it encodes alone as its one id; that the normalizer changes nothing
but the space mark is read in the model's own settings.  The proof is made once,
on the driver, before any text is read, and sent with the job together with the
model's checksum, which every worker compares with its own file.  A pre-token in
the proven set counts one; only the others are merged by the library, once for
each distinct pre-token and worker.

Defined results: a null text is an empty one, with 0 bytes and 0 tokens; a null
doc_id and repeated rows stay; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import Memo, texts, tune

MARK = "▁"
LIMIT = 4096
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*")


@dataclass(frozen=True)
class Proof:
    """Strings that, after one space, are one token of the model with this checksum."""

    checksum: int
    whole: frozenset[str]


def _fields(message: bytes):
    """(number, value) of the fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def normalizer(model: bytes) -> dict[int, object]:
    """The normalizer's settings in a model file, by field: 1 name, 2 map, 3 space before a text, 4 fewer spaces, 5 space mark."""
    held = next((v for k, v in _fields(model) if k == 3), b"")
    return dict(_fields(held))


@functools.lru_cache(maxsize=4)
def prove(model: str) -> Proof:
    """The proven strings; fails if a piece crosses a cut or the normalizer changes texts."""
    import sentencepiece

    data = Path(model).read_bytes()
    settings = normalizer(data)
    # Absent settings are on.
    if settings.get(1, b"identity") != b"identity" or settings.get(2, b"") or not settings.get(3, 1) or settings.get(4, 1) or not settings.get(5, 1):
        raise ValueError("the model's normalizer changes texts")
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    for _, piece in pieces:
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"the piece {piece!r} crosses a cut")
    whole = [(i, piece[1:]) for i, piece in pieces if piece.startswith(MARK) and MARK not in piece[1:]]
    found = frozenset(text for (i, text), ids in zip(whole, sp.encode([t for _, t in whole]), strict=True) if ids == [i] and text)
    return Proof(zlib.crc32(data), found)


class Counter:
    """Counts tokens of texts; keeps the counts of the pre-tokens it has merged."""

    def __init__(self, model: str, proof: Proof | None = None, limit: int = 900_000):
        import sentencepiece

        data = Path(model).read_bytes()
        proof = proof or prove(model)
        if zlib.crc32(data) != proof.checksum:
            raise ValueError(f"{model} is not the model of the proof")
        self.sp, self.whole = sentencepiece.SentencePieceProcessor(model_proto=data), proof.whole
        self.counts = Memo(self._count, limit, "token counts")
        self.merged = 0

    def _count(self, units: list[str]) -> list[int]:
        rest = [u for u in units if u not in self.whole]
        self.merged += len(rest)
        # The library puts a space mark before a text: a unit after a line feed has it too many, a run of spaces holds it already.
        sent = [u[1:] if u.startswith(" ") else u for u in rest]
        found = {u: len(ids) - u.startswith("\n") for u, ids in zip(rest, self.sp.encode(sent, num_threads=1), strict=True)}
        found[""] = 1
        return [found.get(u, 1) for u in units]

    @staticmethod
    def units(text: str) -> list[str]:
        """Pre-tokens: a word after one space as it is, '' for a space that stands alone, else with its spaces or line feed."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text.startswith(" "):
            return [u[1:] if u[0] == " " and u[1:2] != " " else u for u in _UNITS.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.units(t) if t else [] for t in texts]
        self.counts.fill(*cut)
        get = self.counts.__getitem__
        return [sum(map(get, units)) for units in cut]


_COUNTERS: dict[tuple[str, int], Counter] = {}


def counter(model: str, proof: Proof) -> Counter:
    """One counter for each Python worker and model."""
    key = model, proof.checksum
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(model, proof)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text of ``docs``."""
    tune(docs.sparkSession)
    proof = prove(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counter(model, proof).count(texts), pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents for the 32k piece model."""
    import public_tokenizers

    return count_tokens(texts(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
