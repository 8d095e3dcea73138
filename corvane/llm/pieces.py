"""SentencePiece encoding and decoding by a batched Viterbi search.

The pieces of a model get unigram log-probabilities and a text gets the most
probable sequence of pieces.  Texts are cut where no piece can cross (before a
run of spaces and around a line feed); of the distinct cuts, those of equal
length advance together through one numpy search: hashes of all substrings up
to the longest piece probe the sorted hashes of the pieces, and a vectorised
maximum over the possible last pieces stores a back pointer for each position.
Of equal scores the longer last piece wins, as in the library.  A character
that no piece covers is spelt in byte pieces.

The piece files hold merge ranks in place of probabilities; ``zipf`` turns the
rank r of a piece into the log-probability -ln((r + 1) H) of Zipf's law.  A
model that holds log-probabilities is used with ``scores="own"``.

Defined results: a null or empty text has no ids and decodes to the empty
text; decoding restores a text exactly, but for U+2581, which the format itself
turns into a space; repeated rows and null doc_ids stay; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import Memo, texts, tune
from corvane.llm.token_counts import MARK, Counter, prove

UNKNOWN_PENALTY = 10.0
_BASE = 0x9E3779B97F4A7C15
#: Characters (words times length) of one search: bounds its memory.
_CELLS = 120_000


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log-probabilities of ranks 0, 1, ... under Zipf's law."""
    n = len(ranks)
    return (-np.log((ranks + 1) * np.sum(1 / np.arange(1, n + 1)))).astype(np.float32)


class Pieces:
    """A model's pieces with scores: encodes and decodes batches of texts."""

    def __init__(self, model: str, scores: str = "zipf", limit: int = 700_000):
        import sentencepiece

        prove(model)  # the cuts below are sound for this model
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        own = np.array([sp.get_score(i) for i in normal], np.float32)
        value = own if scores == "own" else zipf(np.argsort(np.argsort(-own, kind="stable"), kind="stable"))
        self.score_of = dict(zip(normal, value.tolist(), strict=True))
        self.unknown = np.float32(value.min() - np.float32(UNKNOWN_PENALTY))
        text = [sp.id_to_piece(i) for i in normal]
        self.longest = max(map(len, text))
        keys = np.array([int(self._prefixes(self._points([t]))[0, -1]) for t in text], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.values = keys[order], np.array(normal, np.int32)[order], value[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        byte = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.spell = [b""] * len(ids)
        for i, t in zip(normal, text, strict=True):
            self.spell[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.spell[i] = bytes([b])
        self.memo = Memo(self._search_all, limit, "pieces")

    @staticmethod
    def _points(words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)

    @staticmethod
    def _prefixes(points: np.ndarray) -> np.ndarray:
        """Hashes of every word's prefixes, the empty one first."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        for i in range(points.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(_BASE) + (points[:, i] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return out

    def _search(self, words: list[str]) -> list[bytes]:
        """The best segmentations of words of one length, as little-endian 32-bit ids."""
        points = self._points(words)
        n, length = points.shape
        prefix = self._prefixes(points)
        width = min(self.longest, length)
        # gain[:, e, k]: score of the piece that ends at e and has width - k characters; piece[...]: its id, -1 where unknown.
        gain = np.full((n, length + 1, width), -np.inf, np.float32)
        piece = np.full((n, length + 1, width), -1, np.int32)
        for size in range(1, width + 1):
            key = prefix[:, size:] - prefix[:, :-size] * np.uint64(pow(_BASE, size, 1 << 64))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            gain[:, size:, width - size] = np.where(hit, self.values[at], self.unknown if size == 1 else np.float32(-np.inf))
            piece[:, size:, width - size] = np.where(hit, self.ids[at], -1)
        best = np.full((n, width + length), -np.inf, np.float32)  # best[:, width - 1 + e]: of the first e characters
        best[:, width - 1] = 0
        last = np.zeros((n, length + 1), np.int64)
        rows = np.arange(n)
        for e in range(1, length + 1):
            total = best[:, e - 1 : e - 1 + width] + gain[:, e]
            last[:, e] = k = total.argmax(1)  # the first maximum: the longest piece
            best[:, width - 1 + e] = total[rows, k]
        # Follow the back pointers of all words at once.
        found = np.full((n, length), -2, np.int32)
        end, turn = np.full(n, length), 0
        while True:
            live = end > 0
            if not live.any():
                break
            at = last[rows, end]
            found[live, turn] = piece[rows, end, at][live]
            end = np.where(live, end - (width - at), 0)
            turn += 1
        out = []
        for word, row in zip(words, found[:, :turn][:, ::-1], strict=True):
            ids = row[row != -2]
            if (ids == -1).any():
                at, spelt = 0, []
                for i in ids.tolist():
                    if i == -1:
                        spelt += [self.bytes[b] for b in word[at].encode()]
                        at += 1
                    else:
                        spelt.append(i)
                        at += len(self.spell[i].decode())
                ids = np.array(spelt, "<i4")
            out.append(ids.astype("<i4").tobytes())
        return out

    def _search_all(self, units: list[str]) -> list[bytes]:
        by_length: dict[int, list[str]] = {}
        words = [u if u.startswith("\n") else u.replace(" ", MARK) if u.startswith(" ") else MARK + u for u in units]
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        found = {}
        for length, group in by_length.items():
            step = max(1, _CELLS // length)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                found.update(zip(part, self._search(part), strict=True))
        return [found[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        cut = [Counter.units(t) if t else [] for t in texts]
        self.memo.fill(*cut)
        get = self.memo.__getitem__
        return [b"".join(map(get, units)) for units in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of little-endian 32-bit ids."""
        get = self.spell.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<i4").tolist())).decode("utf-8", "replace")[1:] for x in ids]


@functools.lru_cache(maxsize=2)
def pieces(model: str, scores: str = "zipf") -> Pieces:
    return Pieces(model, scores)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("restored", pa.bool_()), ("exact", pa.bool_())])


def encode_documents(docs: DataFrame, model: str | None = None, scores: str = "zipf") -> DataFrame:
    """doc_id, n_tokens, ids, restored and exact of every whole text.

    Decoding the ids gives the text, character for character (exact), or but
    for space marks (U+2581), which stand for spaces in every piece (restored).
    """
    tune(docs.sparkSession)
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        coder = pieces(model, scores)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = coder.encode(texts)
                back = coder.decode(ids)
                same = [a == b.replace(MARK, " ") for a, b in zip(back, texts, strict=True)]
                exact = [a == b for a, b in zip(back, texts, strict=True)]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same, pa.bool_()), pa.array(exact, pa.bool_())], schema=_ENCODED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, restored boolean, exact boolean")


def decode_documents(encoded: DataFrame, model: str, scores: str = "zipf") -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    tune(encoded.sparkSession)

    def run(batches):
        coder = pieces(model, scores)
        for batch in batches:
            texts = coder.decode([np.asarray(x or [], "<i4").tobytes() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents."""
    return encode_documents(texts(spark, sf_dir, "documents"))
