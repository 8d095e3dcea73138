"""Files under a root, chosen by glob patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import text as tx


def glob_regex(pattern: str) -> str | None:
    """A pattern with **, *, ?, [...] and {a,b} as an anchored regular expression; None if it is malformed."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + (".*" if i in (0,) and len(pattern) == 2 else "[^/]*"), i + 2
            continue
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif ch == "{":
            out, depth = out + "(?:", depth + 1
        elif ch == "}" and depth:
            out, depth = out + ")", depth - 1
        elif ch == "," and depth:
            out += "|"
        elif ch == "\\":
            if i + 1 == len(pattern):
                return None
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(ch)
        i += 1
    return None if depth else f"^{out}$"


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern fits the whole path; a malformed pattern fits nothing."""
    found = F.lit(False)
    for pattern in patterns:
        regex = glob_regex(pattern)
        if regex:
            found = found | path.rlike(regex)
    return found


def walk(spark: SparkSession, root: str, includes: Iterable[str] = (), excludes: Iterable[str] = ()) -> DataFrame:
    """path, rel, mod_time, size and content of the files that are included and not excluded.

    A folder is excluded when a pattern fits its path with a final slash.
    """
    includes, excludes = list(includes) or ["**/*"], list(excludes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", base)) + "/", "")
    files = files.withColumn("rel", rel)
    parts = F.split("rel", "/")
    folders = F.transform(parts, lambda _, i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    folders = F.slice(folders, F.lit(2), F.size(parts) - 1)
    pruned = F.exists(folders, lambda d: matches(d, excludes)) if excludes else F.lit(False)
    kept = files.where(matches(F.col("rel"), includes) & ~matches(F.col("rel"), excludes) & ~pruned)
    return kept.select("path", "rel", F.date_trunc("second", "modificationTime").alias("mod_time"), F.col("length").alias("size"), "content")


def read_documents(spark: SparkSession, root: str, includes: Iterable[str] = (), excludes: Iterable[str] = ()) -> DataFrame:
    """The walked files as documents; identity and language come from the path."""
    files = walk(spark, root, includes, excludes)
    return files.select(tx.doc_id("path").alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"), "mod_time", tx.detect_language("path").alias("lang"))
