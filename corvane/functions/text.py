"""Tokens, counts, paths, identities and previews as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"([\p{L}\p{Nd}_]+)"

# The stop words.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was",
    "were", "will", "with", "this", "have", "had", "but", "not", "you", "your", "we", "our", "they", "their", "she", "her", "his", "if", "or", "so",
    "no", "can", "do", "does", "did", "been", "being", "would", "could", "should", "may", "might", "must", "shall", "which", "who", "whom", "what",
    "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "than", "too", "very", "just",
    "also",
]

# Languages by file extension.
LANGUAGES = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".md": "markdown",
    ".txt": "text",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".sql": "sql",
    ".sh": "shell",
    ".bash": "shell",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text) -> Column:
    """Maximal runs of letters, decimal digits and underscores."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD), F.lit(1))


def _no_tokens() -> str:
    """A pattern of words that are no tokens: stop words, whatever their case, and words of one byte when lower-cased."""
    by_first: dict[str, list[str]] = {}
    for w in STOPWORDS:
        by_first.setdefault(w[0], []).append(w[1:])
    stops = "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(by_first.items()))
    return rf"(?:(?i:{stops})|[A-Za-z0-9_\u212A])(?![\p{{L}}\p{{Nd}}_])"


#: What is no token is consumed and leaves an empty group.
TOKEN = rf"{_no_tokens()}|{WORD}"


def tokenize(text) -> Column:
    """Lower-cased words of at least two bytes that are no stop words, in order, with repeats."""
    words = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.transform(F.array_remove(words, ""), F.lower)


def count_tokens(text) -> Column:
    """The token estimate: 1.3 for each raw word, rounded down."""
    return F.floor(F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(WORD)) * 13 / F.lit(10)).cast("int")


def simple_tokens(text) -> Column:
    """Case-sensitive ASCII words of at least two characters."""
    words = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    return F.filter(words, lambda w: F.length(w) >= 2)


def path_tokens(path) -> Column:
    """Lower-cased parts of a path of at least two bytes."""
    return F.filter(F.split(F.lower(_col(path)), r"[/._\-]+"), lambda t: F.octet_length(t) >= 2)


def detect_language(path) -> Column:
    """Language of the file extension, or 'unknown'."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(_col(path), r"\.[^./]*$", 0)), F.lit("unknown"))


def short_hash(*parts) -> Column:
    """First 8 bytes, in hex, of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[_col(p).cast("string") for p in parts]).cast("binary"), 256), 1, 16)


def doc_id(path) -> Column:
    return short_hash(path)


def line_chunk_id(doc, start0, end) -> Column:
    """Identity of lines [start0, end) of a document, counted from 0."""
    return short_hash(doc, F.concat_ws("-", _col(start0).cast("string"), _col(end).cast("string")))


def unit_chunk_id(doc, kind, name, line) -> Column:
    return short_hash(doc, kind, name, line)


def symbol_id(doc, name, line) -> Column:
    return short_hash(doc, name, line)


def lines_of(text) -> Column:
    """Lines of a text; an empty text has one empty line."""
    return F.split(F.coalesce(_col(text), F.lit("")), "\n", -1)


def full_lines(text) -> Column:
    """Lines without the empty piece after a final line feed."""
    lines = lines_of(text)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def line_slice(lines: Column, start, end) -> Column:
    """Lines start..end, counted from 1 and clamped, joined again."""
    first = F.greatest(_col(start), F.lit(1))
    last = F.least(_col(end), F.size(lines))
    return F.when(first <= last, F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise(F.lit(""))


def preview(text, n: int) -> Column:
    """The first n characters and dots if the text is longer than n bytes; never half a character."""
    c = _col(text)
    return F.when(F.octet_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def line_range(start, end) -> Column:
    return F.format_string("L%d-%d", _col(start), _col(end))


def two_digits(number) -> Column:
    """A number with two digits, rounded half to even from its exact binary value."""
    c = _col(number).cast("double")
    size = F.when((F.abs(c) >= 2.0**-8) & (F.abs(c) < 2.0**50), F.abs(c))
    shift = (53 - F.floor(F.log2(size))).cast("int")  # makes the size whole
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift).cast("decimal(19,0)")
    hundred = (size * F.pow(F.lit(2.0), shift)).cast("long").cast("decimal(19,0)") * F.lit(100).cast("decimal(3,0)")
    down = F.call_function("div", hundred, unit)
    rest = (hundred - down.cast("decimal(18,0)") * unit) * F.lit(2).cast("decimal(1,0)")
    cents = down + F.when((rest > unit) | ((rest == unit) & (down % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.format_string("%.2f", c))


def why(score) -> Column:
    return F.concat(F.lit("BM25 score: "), two_digits(score))


def short_path(path) -> Column:
    """The last segment of a path of more than two segments."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise(_col(path))


def format_number(n) -> Column:
    """Counts in whole thousands (k) and millions (M)."""
    c = _col(n)
    whole = lambda size, unit: F.concat(F.floor(c / size).cast("long").cast("string"), F.lit(unit))
    return F.when(c >= 1_000_000, whole(1_000_000, "M")).when(c >= 1000, whole(1000, "k")).otherwise(c.cast("string"))


def format_duration(seconds) -> Column:
    """Less than a second, whole seconds, minutes and seconds, or hours and minutes."""
    c = _col(seconds).cast("long")
    part = lambda unit, size: F.concat(F.floor(c / size).cast("string"), F.lit(unit))
    return (
        F.when(_col(seconds) < 1, F.lit("<1s"))
        .when(c < 60, F.concat(c.cast("string"), F.lit("s")))
        .when(c < 3600, F.concat(part("m", 60), (c % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(part("h", 3600), F.floor(c % 3600 / 60).cast("string"), F.lit("m")))
    )


def json_in(text) -> Column:
    """From the first opening to the last closing brace; the text itself without them."""
    found = F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(_col(text))
