"""Suffix stripping of English words, and its use on token arrays and vocabularies."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Suffixes and what takes their place, and the suffixes that a long word loses, in the order they are tried.
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
FORMED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LOST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest_first(table: dict[str, str]) -> list[tuple[bytes, bytes]]:
    return [(k.encode(), table[k].encode()) for k in sorted(table, key=len, reverse=True)]


_DERIVED, _FORMED, _LOST = _longest_first(DERIVED), _longest_first(FORMED), [s.encode() for s in LOST]


def _sounds(word: bytes) -> str:
    """v and c for each byte; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in b"aeiou" or (ch == 0x79 and out[-1:] == "c") else "c"
    return out


def _measure(word: bytes) -> int:
    """Times that a vowel is followed by a consonant."""
    return _sounds(word).count("vc")


def _doubled(word: bytes) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _sounds(word)[-1] == "c"


def _short_end(word: bytes) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _sounds(word)[-3:] == "cvc" and word[-1] not in b"wxy"


def _plural(w: bytes) -> bytes:
    if w.endswith((b"sses", b"ies")):
        return w[:-2]
    return w[:-1] if w.endswith(b"s") and not w.endswith(b"ss") else w


def _participle(w: bytes) -> bytes:
    if w.endswith(b"eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for suffix in (b"ed", b"ing"):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if "v" not in _sounds(rest):
                return w
            if rest.endswith((b"at", b"bl", b"iz")):
                return rest + b"e"
            if _doubled(rest) and rest[-1] not in b"lsz":
                return rest[:-1]
            return rest + b"e" if _measure(rest) == 1 and _short_end(rest) else rest
    return w


def _replaced(w: bytes, table: list[tuple[bytes, bytes]]) -> bytes:
    """The longest suffix that fits decides, whether or not enough is left before it."""
    for suffix, new in table:
        if w.endswith(suffix):
            rest = w[: len(w) - len(suffix)]
            return rest + new if _measure(rest) else w
    return w


def _shortened(w: bytes) -> bytes:
    """The first suffix that may go goes; one that may not is no reason to stop."""
    for suffix in _LOST:
        rest = w[: len(w) - len(suffix)]
        if w.endswith(suffix) and _measure(rest) > 1 and (suffix != b"ion" or rest[-1:] in (b"s", b"t")):
            return rest
    return w


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one word; words of fewer than three bytes stay."""
    w = word.encode()
    if len(w) < 3:
        return word
    w = _participle(_plural(word.lower().encode()))
    if w.endswith(b"y") and "v" in _sounds(w[:-1]):
        w = w[:-1] + b"i"
    w = _shortened(_replaced(_replaced(w, _DERIVED), _FORMED))
    if w.endswith(b"e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith(b"ll"):
        w = w[:-1]
    return w.decode("utf-8", "replace")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_arrays(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array of tokens, in Arrow batches; a memo holds the frequent words."""
    return _stem_arrays(tokens)


@F.pandas_udf(T.StringType())
def _stem_words(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """Each distinct term with its stem."""
    return terms.select(term).distinct().withColumn("stem", _stem_words(term))
