"""Cosine similarity and the deterministic stand-in for an embedding service."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine in double precision; 0 for different lengths or a zero vector."""
    a, b = _col(a), _col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def mock_embedding(text, dim: int) -> Column:
    """A vector whose component at a character's byte offset is its code point over 1000.

    Bytes after the first of a character stay 0, as does everything past the text.
    """
    chars = F.filter(F.split(F.coalesce(_col(text), F.lit("")), ""), lambda c: c != "")
    point = lambda c: (F.ascii(c) / F.lit(1000)).cast("float")
    rest = lambda c: F.array_repeat(F.lit(0).cast("float"), F.octet_length(c) - 1)
    spread = F.flatten(F.transform(F.slice(chars, 1, dim), lambda c: F.concat(F.array(point(c)), rest(c))))
    return F.slice(F.concat(spread, F.array_repeat(F.lit(0).cast("float"), dim)), 1, dim)
