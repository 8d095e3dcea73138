"""Mixing sources to target weights by Poisson replication.

A source with n of N rows and target weight w is to be seen w N / n times a
row.  Each document's count is the inverse, at a uniform number hashed from
its doc_id, of the Poisson distribution with that mean; the document is
exploded by its count and all copies are put into one global random order by
a second hash.  Everything is DataFrame functions.

Means above ``PART`` are split into equal parts whose counts add up (a sum of
Poisson counts is one), so that exp(-mean) never vanishes.

Without weights, a source's weight is proportional to its rows to the power
``ALPHA``: large sources are seen less than once, small ones more often.

Defined results: a null source is a source of its own; a row without doc_id is
drawn by the hash of its text; rows that repeat a doc_id (or, without one, a
text) get the same count each; a null text is kept; a source without a weight, or with a null or negative one, has
weight 0; an empty table gives no rows; columns of the same names as the added
ones are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.common import table, written

ALPHA = 0.5
PART = 16
SEED = 17
#: Up to this many sources are broadcast with their distributions; more are joined by salted keys.
BROADCAST_SOURCES = 4096
SALTS = 64


def _name() -> F.Column:
    """What a row is drawn by: its doc_id, else its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def _uniform(*parts) -> F.Column:
    """A number in [0, 1): the first 52 bits of a hash."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, alpha: float = ALPHA) -> DataFrame:
    """One row a source: mix_source (null-safe key), parts and cdf, the distribution of one part."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    counts = docs.select(key.alias("mix_source")).groupBy("mix_source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = weights.select(key.alias("mix_source"), F.col("weight").cast("double").alias("w")).groupBy("mix_source").agg(F.sum("w").alias("w"))
        counts = counts.join(given, "mix_source", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    counts = written(counts, "mix-counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    scale = epochs * (total["n"] or 0) / total["w"] if total["w"] else 0.0
    rates = counts.withColumn("rate", F.col("w") * F.lit(scale) / F.col("n"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    # Terms beyond mean + 12 sqrt(mean) + 20 are below what 52 bits can meet.
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int"))
    first = F.exp(-F.col("mean"))
    state = F.struct(first.alias("p"), F.array(first).alias("c"))

    def more(s, j):
        p = s["p"] * F.col("mean") / j
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return rates.select("mix_source", "parts", F.aggregate(steps, state, more, lambda s: s["c"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Copies of the rows of ``docs``, with n_copies, copy and shuffle_key, in global random order."""
    rates = written(source_rates(docs, weights, epochs, alpha), "mix-rates")
    rows = docs.drop("mix_source", "parts", "cdf", "n_copies", "copy", "shuffle_key", "mix_salt")
    rows = rows.withColumn("mix_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    if rates.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), "mix_source")
    else:  # a hot source is spread over the salts
        rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64(_name()), F.lit(SALTS)).cast("int"))
        rates = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(rates, ["mix_source", "mix_salt"]).drop("mix_salt")

    def draw(j):
        """The count of part j; the hash is bound to a variable, so it is taken once and not for each term."""
        u = _uniform(F.lit(seed), _name(), j)
        return F.element_at(F.transform(F.array(u), lambda x: F.size(F.filter("cdf", lambda c: x >= c))), 1)

    rest = F.aggregate(F.when(F.col("parts") > 1, F.sequence(F.lit(2), F.col("parts"))).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, j: a + draw(j))
    rows = rows.withColumn("n_copies", (draw(F.lit(1)) + rest).cast("int")).where("n_copies > 0").drop("cdf", "parts", "mix_source")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", _uniform(F.lit(seed + 1), _name(), F.col("copy")))
    # A hash deals the copies out and a sort orders each part: together a random order of all.
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the square roots of their sources' sizes."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy", "shuffle_key")


ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, w * (SELECT sum(n)::DOUBLE / sum(w) FROM counts) / n AS rate FROM counts
), means AS (
  SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM rates
), terms AS (
  SELECT source, mean, parts, 0 AS j, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, mean, parts, j + 1, p * mean / (j + 1), c + p * mean / (j + 1) FROM terms WHERE j < ceil(mean + 12 * sqrt(mean) + 20)
), draws AS (
  SELECT d.doc_id, d.source, unnest(range(1, m.parts + 1)) AS part FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source
), hashed AS (
  SELECT doc_id, source, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || part), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM draws
), sizes AS (
  SELECT h.doc_id, count(*)::INT AS n_copies FROM hashed h JOIN terms t ON h.source IS NOT DISTINCT FROM t.source AND h.u >= t.c GROUP BY h.doc_id
), copies AS (
  SELECT doc_id, n_copies, unnest(range(1, n_copies + 1))::INT AS copy FROM sizes
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.n_copies, c.copy,
  ('0x' || substr(md5('{SEED + 1}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || c.copy), 1, 13))::BIGINT / {float(1 << 52)} AS shuffle_key
FROM documents d JOIN copies c USING (doc_id)
"""
