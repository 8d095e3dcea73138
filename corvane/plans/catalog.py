"""The query catalogue: each entry takes (spark, sf_dir); most have an oracle in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import stem, text as tx, vector
from corvane.operators import chunking, expand, index, metrics, packing, rerank, retrieval
from corvane.plans.samples import PATHS
from corvane.sources import corpus

QUERY = "ering heonst ontion la que der thand"
TERMS = QUERY.split()
REPEATED = "ering ering que heonst"
MOST, OVERLAP, BUDGET = 128, 20, 400

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def entry(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of oracles ------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{Nd}}_]+')"


def _tokens(c: str) -> str:
    return f"list_filter(list_transform({_words(c)}, lambda w: lower(w)), lambda w: strlen(w) >= 2 AND NOT list_contains({_STOP}, w))"


def _count(c: str) -> str:
    return f"(len({_words(c)}) * 13 // 10)::INT"


_DOCS = f"""
docs AS (
  SELECT doc_id AS num, '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
    substr(sha256('/' || source || '/' || lang || '/doc_' || doc_id || '.txt'), 1, 16) AS doc_id,
    coalesce(text, '') AS text, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 60)::INT * INTERVAL 1 DAY AS mod_time
  FROM documents
), toks AS (
  SELECT num, doc_id AS chunk_id, doc_id, path, text, mod_time, {_tokens("text")} AS tokens FROM docs
)"""


def _bm25(queries: str, weight: float = 0.0) -> str:
    """CTEs up to ``scored`` (query_id, chunk_id, num, score) for a FROM item with query_id and text."""
    boost = f"* (1 + {weight} * len(list_filter(list_filter(regexp_split_to_array(lower(c.path), '[/._\\-]+'), lambda t: strlen(t) >= 2), lambda t: list_contains(qs.terms, t)))::DOUBLE / len(qs.terms))" if weight else ""
    return f"""{_DOCS}, qterms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("text")}) AS term FROM {queries}) GROUP BY query_id, term
), qsets AS (SELECT query_id, list(term) AS terms FROM qterms GROUP BY query_id
), stats AS (SELECT count(*)::DOUBLE AS total, avg(len(tokens)) AS mean FROM toks
), exploded AS (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks
), posted AS (
  SELECT term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM exploded WHERE term IN (SELECT term FROM qterms) GROUP BY term, chunk_id
), freq AS (SELECT term, count(*) AS n FROM posted GROUP BY term
), sums AS (
  SELECT q.query_id, p.chunk_id,
    round(sum(q.qtf * ln((s.total - f.n + 0.5) / (f.n + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.mean))), 9) AS score
  FROM qterms q JOIN posted p USING (term) JOIN freq f USING (term) CROSS JOIN stats s GROUP BY q.query_id, p.chunk_id
), scored AS (
  SELECT m.query_id, m.chunk_id, c.num, m.score {boost} AS score FROM sums m JOIN toks c USING (chunk_id) JOIN qsets qs USING (query_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored
)"""


_ONE = f"(SELECT 0::BIGINT AS query_id, '{QUERY}' AS text)"


def _asked(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole_documents(corpus.documents(spark, sf_dir))


def _distinct(spark: SparkSession, sf_dir: str) -> bool:
    """Whether no doc_id is repeated, so that no two passages have the same id."""
    return not index.repeats(corpus.table(spark, sf_dir, "documents"), "doc_id")


def _shown(found: DataFrame) -> DataFrame:
    """Results by the documents' own numbers, scores rounded to what both engines agree on."""
    return found.select("query_id", F.col("num").alias("doc_num"), F.round("score", 6).alias("score"), "rank")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries."""
    return corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- text ---------------------------------------------------------------------------


@entry(f"SELECT doc_id, unnest(range(1, len(t) + 1))::INT - 1 AS pos, unnest(t) AS token FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def tokenize_terms(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select("doc_id", F.posexplode(tx.tokenize("text")).alias("pos", "token"))


@entry(f"SELECT doc_id, {_count('text')} AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select("doc_id", tx.count_tokens("text").alias("n_tokens"))


@entry(f"WITH {_DOCS} SELECT num, unnest(list_filter(regexp_split_to_array(lower(path), '[/._\\-]+'), lambda t: strlen(t) >= 2)) AS token FROM docs")
def path_tokens(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("num", F.explode(tx.path_tokens("path")).alias("token"))


_MAP = ", ".join(f"'{k}': '{v}'" for k, v in tx.LANGUAGES.items())


_ENDINGS = [*tx.LANGUAGES, ".unknown", "", "/Makefile", ".tar.gz"]
_ENDING = f"[{', '.join(f"'{x}'" for x in _ENDINGS)}][(num % {len(_ENDINGS)} + {len(_ENDINGS)}) % {len(_ENDINGS)} + 1]"


@entry(f"WITH {_DOCS}, p AS (SELECT num, doc_id || {_ENDING} AS path FROM docs) SELECT num, path, coalesce(MAP {{{_MAP}}}[regexp_extract(path, '\\.[^./]*$')], 'unknown') AS lang FROM p")
def detect_language(spark, sf_dir):
    """Every document under a file name of each ending in turn."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.pmod("num", F.lit(len(_ENDINGS))) + 1).cast("int"))
    return corpus.documents(spark, sf_dir).select("num", F.concat("doc_id", ending).alias("path")).withColumn("lang", tx.detect_language("path"))


@entry(f"WITH {_DOCS} SELECT num, path, doc_id FROM docs")
def doc_ids(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("num", "path", "doc_id")


@entry(f"""SELECT doc_id, n_chars, CASE WHEN strlen(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview,
  CASE WHEN n_chars >= 1000000 THEN n_chars // 1000000 || 'M' WHEN n_chars >= 1000 THEN n_chars // 1000 || 'k' ELSE n_chars::VARCHAR END AS size,
  CASE WHEN n_chars < 1 THEN '<1s' WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN n_chars // 60 || 'm' || n_chars % 60 || 's' ELSE n_chars // 3600 || 'h' || n_chars % 3600 // 60 || 'm' END AS duration,
  printf('BM25 score: %.2f', n_chars / 800) AS why FROM documents""")
def display_formats(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars", tx.preview("text", 150).alias("preview"), tx.format_number("n_chars").alias("size"), tx.format_duration("n_chars").alias("duration"), tx.why(F.col("n_chars") / 800).alias("why"))


@entry(r"""SELECT event_id, coalesce(nullif(regexp_extract('note ' || props || ' end', '(?s)\{.*\}'), ''), 'note ' || props || ' end') AS found FROM events""")
def json_extract(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", tx.json_in(F.concat(F.lit("note "), "props", F.lit(" end"))).alias("found"))


# --- index --------------------------------------------------------------------------


@entry(f"WITH {_DOCS} SELECT DISTINCT unnest(tokens) AS term FROM toks")
def vocabulary(spark, sf_dir):
    return _whole(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct()


@entry(f"WITH {_DOCS} SELECT term, num, count(*) AS tf FROM (SELECT num, unnest(tokens) AS term FROM toks) GROUP BY term, num")
def term_freq(spark, sf_dir):
    chunks = _whole(spark, sf_dir).withColumn("chunk_id", F.col("num"))
    return index.postings(chunks, _distinct(spark, sf_dir)).withColumnRenamed("chunk_id", "num")


@entry(f"WITH {_DOCS} SELECT term, count(DISTINCT num) AS n_chunks FROM (SELECT num, unnest(tokens) AS term FROM toks) GROUP BY term")
def doc_freq(spark, sf_dir):
    return index.passages_with(_whole(spark, sf_dir), _distinct(spark, sf_dir))


@entry(f"""WITH {_DOCS} SELECT count(DISTINCT doc_id) AS total_docs, count(*) AS total_chunks, round(avg(len(tokens)), 6) AS avg_chunk_len,
  sum(strlen(text))::BIGINT AS total_bytes, (sum(strlen(text)) // 4)::BIGINT AS total_tokens FROM toks""")
def corpus_stats(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    size = F.sum(F.octet_length("text"))
    return chunks.agg(F.countDistinct("doc_id").alias("total_docs"), F.count("*").alias("total_chunks"), F.round(F.avg(F.size("tokens")), 6).alias("avg_chunk_len"), size.alias("total_bytes"), F.floor(size / 4).alias("total_tokens"))


def _stem_sql(words: str) -> str:
    """CTEs up to ``stems`` (term, w) for a relation of terms: each step of the stemmer as one select.

    ``s`` spells a word's bytes in v and c, so that its beginnings spell the word's beginnings.
    """
    sounds = "list_reduce(list_prepend('', string_split(w, '')), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE repeat('c', strlen(x)) END)"
    left = lambda n: f"left(w, length(w) - {n})"
    begun = lambda n: f"left(s, strlen(w) - {n})"
    measure = lambda n: f"((length({begun(n)}) - length(replace({begun(n)}, 'vc', ''))) // 2)"
    short = lambda n: f"(suffix({begun(n)}, 'cvc') AND right({left(n)}, 1) NOT IN ('w', 'x', 'y'))"

    def participle(n):
        rest = left(n)
        return f"""CASE WHEN NOT contains({begun(n)}, 'v') THEN w WHEN suffix({rest}, 'at') OR suffix({rest}, 'bl') OR suffix({rest}, 'iz') THEN {rest} || 'e'
          WHEN length({rest}) > 1 AND strlen(right({rest}, 1)) = 1 AND right({rest}, 1) = substr({rest}, length({rest}) - 1, 1) AND suffix({begun(n)}, 'c') AND right({rest}, 1) NOT IN ('l', 's', 'z') THEN {left(n + 1)}
          WHEN {measure(n)} = 1 AND {short(n)} THEN {rest} || 'e' ELSE {rest} END"""

    def replaced(table):
        return "CASE " + " ".join(f"WHEN suffix(w, '{k}') THEN CASE WHEN {measure(len(k))} > 0 THEN {left(len(k))} || '{table[k]}' ELSE w END" for k in sorted(table, key=len, reverse=True)) + " ELSE w END"

    lost = "CASE " + " ".join(f"WHEN suffix(w, '{k}') AND {measure(len(k))} > 1{" AND right(" + left(3) + ", 1) IN ('s', 't')" if k == "ion" else ""} THEN {left(len(k))}" for k in stem.LOST) + " ELSE w END"
    steps = [
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {left(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {left(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {measure(3)} > 0 THEN {left(1)} ELSE w END WHEN suffix(w, 'ed') THEN {participle(2)} WHEN suffix(w, 'ing') THEN {participle(3)} ELSE w END",
        f"CASE WHEN suffix(w, 'y') AND contains({begun(1)}, 'v') THEN {left(1)} || 'i' ELSE w END",
        replaced(stem.DERIVED),
        replaced(stem.FORMED),
        lost,
        f"CASE WHEN suffix(w, 'e') AND ({measure(1)} > 1 OR ({measure(1)} = 1 AND NOT {short(1)})) THEN {left(1)} ELSE w END",
        f"CASE WHEN {measure(0)} > 1 AND suffix(w, 'll') THEN {left(1)} ELSE w END",
    ]
    ctes = [f"stem0 AS (SELECT DISTINCT term, lower(term) AS w FROM {words})"]
    for i, step in enumerate(steps, 1):
        ctes.append(f"stem{i} AS (SELECT term, CASE WHEN strlen(term) < 3 THEN term ELSE {step} END AS w FROM (SELECT term, w, {sounds} AS s FROM stem{i - 1}))")
    return ", ".join(ctes) + f", stems AS (SELECT term, w FROM stem{len(steps)})"


@entry(f"WITH {_DOCS}, words AS (SELECT DISTINCT unnest(tokens) AS term FROM toks), {_stem_sql('words')} SELECT term, w AS stem FROM stems")
def stem_vocabulary(spark, sf_dir):
    return stem.stem_vocabulary(vocabulary(spark, sf_dir))


def _chunk_ctes(most: int, overlap: int, lines: str = "SELECT num, doc_id, regexp_split_to_array(text, chr(10)) AS ls FROM docs") -> str:
    """CTEs up to ``chunks`` (num, doc_id, chunk_id, start_line, end_line, text) of the line passages of ``lines`` (num, doc_id, ls)."""
    return f"""counted AS ({lines}
), ruled AS (
  SELECT num, doc_id, ls, len(ls) AS n, list_prepend(0::BIGINT, list_transform(range(1, len(ls) + 1), lambda i: list_sum(list_transform(ls[1:i], lambda l: {_count('l')}))::BIGINT)) AS cum FROM counted
), spans AS (
  SELECT num, doc_id, n, cum, 0::BIGINT AS a,
    coalesce(list_min(list_filter(range(1, n), lambda e: cum[e + 1] > cum[1] AND cum[e + 2] - cum[1] > {most})), n) AS b FROM ruled
  UNION ALL
  SELECT num, doc_id, n, cum, c, coalesce(list_min(list_filter(range(c + 1, n), lambda e: cum[e + 1] > cum[c + 1] AND cum[e + 2] - cum[c + 1] > {most})), n)
  FROM (SELECT *, least(greatest(coalesce(list_max(list_filter(range(a, b), lambda s: cum[b + 1] - cum[s + 1] >= {overlap})), a), a + 1), b) AS c FROM spans) WHERE c < n
), chunks AS (
  SELECT s.num, s.doc_id, substr(sha256(s.doc_id || ':' || a || '-' || b), 1, 16) AS chunk_id, (a + 1)::INT AS start_line, b::INT AS end_line,
    regexp_replace(array_to_string(r.ls[a + 1:b], chr(10)), '^\\n+', '') AS text
  FROM spans s JOIN ruled r USING (num)
)"""


_CHUNKS = f"{_DOCS}, {_chunk_ctes(MOST, OVERLAP)}"


def _lines(spark, sf_dir):
    return chunking.line_chunks(corpus.documents(spark, sf_dir), MOST, OVERLAP)


@entry(f"WITH RECURSIVE {_CHUNKS} SELECT num, chunk_id, start_line, end_line, length(text)::INT AS n_chars, {_count('text')} AS n_tokens FROM chunks")
def line_chunks(spark, sf_dir):
    return _lines(spark, sf_dir).select("num", "chunk_id", "start_line", "end_line", F.length("text").alias("n_chars"), tx.count_tokens("text").alias("n_tokens"))


@entry(f"WITH RECURSIVE {_CHUNKS} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM chunks) GROUP BY term, chunk_id")
def postings_by_chunk(spark, sf_dir):
    return index.postings(_lines(spark, sf_dir), _distinct(spark, sf_dir))


# --- retrieval ----------------------------------------------------------------------

_SHOW = "SELECT query_id, num AS doc_num, round(score, 6) AS score, rank FROM ranked WHERE rank <= {k}"


@entry(f"WITH {_bm25(_ONE)} {_SHOW.format(k=10)}")
def bm25_topk(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    return _shown(retrieval.bm25(_asked(spark, QUERY), chunks, 10, keep=("num",)))


_BENCH = "(SELECT item_id AS query_id, text FROM benchmark)"


@entry(f"WITH {_bm25(_BENCH)} {_SHOW.format(k=10)}")
def bm25_batch(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _benchmark(spark, sf_dir)
    return _shown(retrieval.bm25(asked, chunks, 10, keep=("num",)))


@entry(f"WITH {_bm25(f"(SELECT 0::BIGINT AS query_id, '{REPEATED}' AS text)")} {_SHOW.format(k=20)}")
def bm25_repeated_terms(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    return _shown(retrieval.bm25(_asked(spark, REPEATED), chunks, 20, keep=("num",)))


_PATHQ = "ering src3 src11 fr que"


@entry(f"WITH {_bm25(f"(SELECT 0::BIGINT AS query_id, '{_PATHQ}' AS text)", 0.3)} {_SHOW.format(k=20)}")
def bm25_path_boost(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    return _shown(retrieval.bm25(_asked(spark, _PATHQ), chunks, 20, path_weight=0.3, keep=("num",)))


@entry(f"""WITH {_bm25(_ONE)} SELECT q.query_id, c.num AS doc_num, round(sum(q.qtf * ln((s.total - 1 + 0.5) / 1.5 + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.mean))), 6) AS score
  FROM qterms q JOIN posted p USING (term) JOIN toks c USING (chunk_id) CROSS JOIN stats s GROUP BY q.query_id, c.num""")
def bm25_single_chunk(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    found = retrieval.single_chunk_bm25(_asked(spark, QUERY), chunks, keep=("num",))
    return found.select("query_id", F.col("num").alias("doc_num"), F.round("score", 6).alias("score"))


@entry(f"WITH {_bm25(_BENCH)} {_SHOW.format(k=20)} AND score >= 12.0")
def bm25_threshold(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _benchmark(spark, sf_dir)
    return _shown(retrieval.threshold(retrieval.bm25(asked, chunks, 20, keep=("num",)), 12.0))


_VECQ = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (3, 77, 123)"
_COS = "list_dot_product(q.q, e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"


def _vectors(spark, sf_dir):
    return corpus.table(spark, sf_dir, "embeddings").select(F.format_string("%012d", "vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, sf_dir):
    """Three stated vectors as queries."""
    return corpus.table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(3, 77, 123)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COSTOP = f"scores AS (SELECT q.query_id, e.vec_id, {_COS} AS score FROM ({_VECQ}) q CROSS JOIN embeddings e), tops AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)"


@entry(f"WITH {_COSTOP} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM tops WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    found = retrieval.vector_top(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 10)
    return found.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@entry(f"WITH {_COSTOP} SELECT query_id, vec_id, round(score, 6) AS score FROM scores WHERE (vec_id * 7 + query_id) % 5 = 0")
def cosine_subset(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    asked = _vector_queries(spark, sf_dir)
    wanted = vectors.select("id").join(F.broadcast(asked.select("query_id")), (F.col("id").cast("long") * 7 + F.col("query_id")) % 5 == 0).select("query_id", F.col("id").alias("chunk_id"))
    found = retrieval.vector_subset(asked, vectors, wanted)
    return found.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@entry(f"WITH {_COSTOP} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM tops WHERE rank <= 20 AND vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def semantic_search(spark, sf_dir):
    chunks = corpus.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.format_string("%012d", "doc_id").alias("chunk_id"))
    found = retrieval.semantic(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), chunks, 20)
    return found.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


_HYBRID = f"""{_bm25(_ONE)}, cand AS (SELECT * FROM ranked WHERE rank <= 100
), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3
), cos AS (SELECT e.vec_id, {_COS} AS c FROM q CROSS JOIN embeddings e
), low AS (SELECT min(score) AS lo, CASE WHEN max(score) > min(score) THEN max(score) - min(score) ELSE 1 END AS span FROM cand
), mixed AS (
  SELECT query_id, chunk_id, num, 0.5 * (score - lo) / span + 0.5 * coalesce(c, 0) AS score FROM cand CROSS JOIN low LEFT JOIN cos ON cos.vec_id = cand.num
), final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM mixed)"""


@entry(f"WITH {_HYBRID} SELECT query_id, num AS doc_num, round(score, 6) AS score, rank FROM final WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    emb = corpus.table(spark, sf_dir, "embeddings")
    vectors = emb.join(chunks.select("num", "chunk_id"), F.col("vec_id") == F.col("num")).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    asked = _asked(spark, QUERY).join(F.broadcast(emb.where("vec_id = 3").select(F.col("embedding").alias("vector"))), F.lit(True))
    found = retrieval.hybrid(asked, chunks, vectors, 10)
    return _shown(retrieval.with_columns_of(found, chunks, asked, 10, "num"))


@entry("""WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), '')[1:32] AS cs FROM documents), e AS (
  SELECT doc_id, list_transform(range(1, 33), lambda p: list_sum(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN 1 + list_sum(list_transform(list_prepend('', cs[1:i - 1]), lambda x: strlen(x))) = p THEN unicode(cs[i]) ELSE 0 END))) AS v FROM c
) SELECT doc_id, list_transform(v, lambda x: (coalesce(x, 0) / 1000)::FLOAT) AS vector FROM e""")
def mock_embed(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select("doc_id", vector.mock_embedding("text", 32).alias("vector"))


@entry(f"""WITH {_bm25(_ONE)}, texts(query_id, text) AS (VALUES (0::BIGINT, '{QUERY}'), (1, '{REPEATED}')),
 x AS (SELECT term, query_id, count(*) AS qtf FROM (SELECT query_id, unnest(str_split(text, ' ')) AS term FROM texts) GROUP BY term, query_id),
 y AS (SELECT x.query_id, p.chunk_id, round(sum(x.qtf * ln((s.total - f.n + 0.5) / (f.n + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.mean))), 9) AS score
   FROM x JOIN posted p USING (term) JOIN freq f USING (term) CROSS JOIN stats s GROUP BY x.query_id, p.chunk_id),
 z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM y)
 SELECT num AS doc_num, round(max(score), 6) AS score FROM z JOIN toks USING (chunk_id) WHERE r <= 20 GROUP BY num""")
def pool_max_score(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _asked(spark, QUERY, REPEATED)
    best = retrieval.pooled(retrieval.bm25(asked, chunks, 20))
    return retrieval.with_columns_of(best, chunks, asked, 20, "num").select(F.col("num").alias("doc_num"), F.round("score", 6).alias("score"))


# --- re-ranking -----------------------------------------------------------------------

_JAC = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


@entry(f"""WITH {_bm25(_ONE)}, c AS (SELECT r.num, list_distinct(t.tokens) AS s FROM ranked r JOIN toks t USING (chunk_id) WHERE rank <= 40)
 SELECT a.num AS a, b.num AS b, round({_JAC.format(a='a.s', b='b.s')}, 6) AS jaccard FROM c a JOIN c b ON a.num < b.num""")
def jaccard_pairs(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _asked(spark, QUERY)
    found = retrieval.with_columns_of(retrieval.bm25(asked, chunks, 40), chunks, asked, 40, "num", "text").select("query_id", "num", tx.tokenize("text").alias("tokens"))
    a = found.select("query_id", F.col("num").alias("a"), F.col("tokens").alias("s"))
    b = found.select("query_id", F.col("num").alias("b"), F.col("tokens").alias("t"))
    return a.join(b, "query_id").where("a < b").select("a", "b", F.round(rerank.jaccard("s", "t"), 6).alias("jaccard"))


_MMR = f"""{_bm25(_BENCH)}, c AS (
  SELECT r.query_id, r.num, r.rank, r.score, list_distinct(t.tokens) AS s FROM ranked r JOIN toks t USING (chunk_id) WHERE rank <= 20
), top AS (SELECT query_id, CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END AS m FROM c GROUP BY query_id
), pairs AS (
  SELECT a.query_id, a.num AS x, b.num AS y, {_JAC.format(a='a.s', b='b.s')} AS j FROM c a JOIN c b ON a.query_id = b.query_id AND a.num <> b.num
), steps AS (
  SELECT query_id, num, score, 1 AS step, [num] AS done FROM c WHERE rank = 1
  UNION ALL
  SELECT query_id, num, score, step, done FROM (
    SELECT s.query_id, c.num, c.score, s.step + 1 AS step, list_append(s.done, c.num) AS done,
      row_number() OVER (PARTITION BY s.query_id ORDER BY 0.7 * c.score / t.m - (1 - 0.7) * near.j DESC, c.rank) AS r
    FROM steps s JOIN c ON c.query_id = s.query_id AND NOT list_contains(s.done, c.num) JOIN top t ON t.query_id = s.query_id
    JOIN LATERAL (SELECT coalesce(max(p.j), 0) AS j FROM pairs p WHERE p.query_id = s.query_id AND p.x = c.num AND list_contains(s.done, p.y)) near ON near.j <= 0.8
    WHERE s.step < 5
  ) WHERE r = 1
)"""


@entry(f"WITH RECURSIVE {_MMR} SELECT query_id, num AS doc_num, round(score, 6) AS score, step::INT AS rank FROM steps")
def mmr_rerank(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _benchmark(spark, sf_dir)
    found = retrieval.with_columns_of(retrieval.bm25(asked, chunks, 20), chunks, asked, 20, "text")
    chosen = rerank.mmr(found.withColumn("tokens", tx.tokenize("text")), 5)
    return _shown(retrieval.with_columns_of(chosen, chunks, asked, 5, "num"))


@entry(f"""WITH {_bm25(_BENCH)}, c AS (
  SELECT r.query_id, r.num, r.chunk_id, list_distinct(list_filter(regexp_extract_all(q.text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2)) AS q,
    list_distinct(list_filter(regexp_extract_all(t.text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2)) AS d, r.rank
  FROM ranked r JOIN toks t USING (chunk_id) JOIN benchmark q ON q.item_id = r.query_id WHERE rank <= 50
), s AS (
  SELECT *, CASE WHEN len(q) = 0 THEN 1 - 0.01 * (rank - 1) WHEN len(d) = 0 THEN 0.0 ELSE len(list_intersect(q, d))::DOUBLE / len(q) END AS score FROM c
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS place FROM s)
SELECT query_id, num AS doc_num, round(score, 6) AS score, place AS rank FROM o WHERE place <= 10""")
def simple_rerank(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    asked = _benchmark(spark, sf_dir)
    found = retrieval.with_columns_of(retrieval.bm25(asked, chunks, 50), chunks, asked, 50, "text")
    return _shown(retrieval.with_columns_of(rerank.rerank(found, asked, 10), chunks, asked, 10, "num"))


# --- packing --------------------------------------------------------------------------


def _packable(spark, sf_dir, k: int = 20):
    """Passages by line chunks for one query, with what packing needs; their texts are cut again from the few documents found."""
    asked = _asked(spark, QUERY)
    found = retrieval.bm25(asked, _lines(spark, sf_dir), k, keep=("num", "doc_id", "path", "mod_time", "start_line", "end_line"), distinct=_distinct(spark, sf_dir))
    docs = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("whole"))
    wide = retrieval.with_columns_of(found.withColumnRenamed("chunk_id", "id").withColumn("chunk_id", F.col("doc_id")), docs, asked, k, "whole")
    text = F.regexp_replace(tx.line_slice(tx.lines_of("whole"), F.col("start_line"), F.col("end_line")), "^\n+", "")
    return wide.withColumn("text", text).drop("whole", "chunk_id").withColumnRenamed("id", "chunk_id")


_LINEBM = f"""{_CHUNKS}, qterms AS (
  SELECT term, count(*) AS qtf FROM (SELECT unnest(str_split('{QUERY}', ' ')) AS term) GROUP BY term
), ctoks AS (SELECT chunk_id, {_tokens('text')} AS tokens FROM chunks
), stats AS (SELECT count(*)::DOUBLE AS total, avg(len(tokens)) AS mean FROM ctoks
), posted AS (
  SELECT term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM ctoks) WHERE term IN (SELECT term FROM qterms) GROUP BY term, chunk_id
), freq AS (SELECT term, count(*) AS n FROM posted GROUP BY term
), scored AS (
  SELECT p.chunk_id, round(sum(q.qtf * ln((s.total - f.n + 0.5) / (f.n + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.mean))), 9) AS score
  FROM qterms q JOIN posted p USING (term) JOIN freq f USING (term) CROSS JOIN stats s GROUP BY p.chunk_id
), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM scored
), cand AS (
  SELECT r.chunk_id, r.score, r.rank, c.num, c.doc_id, c.start_line, c.end_line, c.text, d.path, d.mod_time
  FROM ranked r JOIN chunks c USING (chunk_id) JOIN docs d ON d.num = c.num WHERE rank <= 20
), used AS (
  SELECT *, greatest({_count('text')}, 1) AS n_tokens,
    score * (1 + 0.1 * (1 - age) - 0.1 * age) / greatest({_count('text')}, 1) AS utility
  FROM (SELECT *, least(1.0, (epoch(max(mod_time) OVER ()) - epoch(mod_time)) / 86400.0 / 30) AS age FROM cand)
), lined AS (SELECT *, row_number() OVER (ORDER BY utility DESC, chunk_id) AS place FROM used
), fold AS (
  SELECT 0::BIGINT AS place, 0 AS total, false AS taken
  UNION ALL
  SELECT l.place, CASE WHEN f.total + l.n_tokens <= {BUDGET} THEN f.total + l.n_tokens ELSE f.total END, f.total + l.n_tokens <= {BUDGET} FROM fold f JOIN lined l ON l.place = f.place + 1
), chosen AS (SELECT l.* FROM lined l JOIN fold f USING (place) WHERE f.taken
), flagged AS (
  SELECT *, CASE WHEN start_line > 1 + max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM @source
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line, end_line, chunk_id) AS island FROM flagged
), merged AS (
  SELECT doc_id, any_value(path) AS path, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score, string_agg(text, chr(10) ORDER BY start_line, end_line, chunk_id) AS text FROM islands GROUP BY doc_id, island
)"""


@entry(f"WITH RECURSIVE {_LINEBM.replace('@source', 'chosen')} SELECT chunk_id, num AS doc_num, n_tokens, round(utility, 6) AS utility FROM used")
def pack_utility(spark, sf_dir):
    return packing.utility(_packable(spark, sf_dir)).select("chunk_id", F.col("num").alias("doc_num"), "n_tokens", F.round("utility", 6).alias("utility"))


@entry(f"WITH RECURSIVE {_LINEBM.replace('@source', 'chosen')} SELECT chunk_id, num AS doc_num, n_tokens FROM chosen")
def pack_greedy(spark, sf_dir):
    return packing.greedy(packing.utility(_packable(spark, sf_dir)), BUDGET).select("chunk_id", F.col("num").alias("doc_num"), "n_tokens")


@entry(f"WITH RECURSIVE {_LINEBM.replace('@source', 'cand')} SELECT path, start_line, end_line, round(score, 6) AS score, text FROM merged")
def pack_merge(spark, sf_dir):
    found = _packable(spark, sf_dir)
    merged = packing.merge_adjacent(found).join(found.select("doc_id", "path").distinct(), "doc_id")
    return merged.select("path", "start_line", "end_line", F.round("score", 6).alias("score"), "text")


_PACKED = f"""{_LINEBM.replace('@source', 'chosen')}, snippets AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, path, start_line) AS rank, {_count('text')} AS used FROM merged
)"""


@entry(f"""WITH RECURSIVE {_PACKED} SELECT '{QUERY}' AS query, {BUDGET} AS budget_tokens, sum(used)::BIGINT AS used_tokens, count(*)::INT AS n_snippets,
  string_agg(path || ' ' || 'L' || start_line || '-' || end_line || ' ' || printf('BM25 score: %.2f', score), chr(10) ORDER BY rank) AS listed,
  string_agg('=== ' || path || ':L' || start_line || '-' || end_line || ' ===' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS context FROM snippets""")
def packed_context(spark, sf_dir):
    packed = packing.packed_context(_asked(spark, QUERY), _packable(spark, sf_dir), corpus.documents(spark, sf_dir), BUDGET)
    listed = F.array_join(F.transform("snippets", lambda s: F.concat_ws(" ", s["path"], s["range"], s["why"])), "\n")
    context = packing.context_text(packed)
    return packed.join(context, "query_id").select("query", "budget_tokens", "used_tokens", F.size("snippets").alias("n_snippets"), listed.alias("listed"), "context")


_PROMPT = packing.RUNTIME.replace("'", "''").split("{query}")
_TAIL = _PROMPT[1].split("{snippets}")


@entry(f"""WITH RECURSIVE {_PACKED} SELECT '{_PROMPT[0]}' || '{QUERY}' || '{_TAIL[0]}' ||
  string_agg('- ' || path || ' L' || start_line || '-' || end_line || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || '{_TAIL[1]}' AS prompt FROM snippets""")
def prompt_render(spark, sf_dir):
    packed = packing.packed_context(_asked(spark, QUERY), _packable(spark, sf_dir), corpus.documents(spark, sf_dir), BUDGET)
    return packing.prompts(packed).select("prompt")


# --- expansion ------------------------------------------------------------------------

_KEYQ = ["Auth config parse", "db err", "nothing here", "init the cache log"]
_PAIRS = ", ".join(f"('{a}', {i}, '{s}')" for a in sorted(expand.SYNONYMS) for i, s in enumerate(expand.SYNONYMS[a]))
_KEYS = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(_KEYQ))


@entry(f"""WITH q(query_id, text) AS (VALUES {_KEYS}), syn(a, i, s) AS (VALUES {_PAIRS}),
 v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY a, i)::INT AS variant, replace(lower(text), a, s) AS text FROM q JOIN syn ON contains(lower(text), a) WHERE replace(lower(text), a, s) <> lower(text))
 SELECT query_id, 0 AS variant, text FROM q UNION ALL SELECT query_id, variant, text FROM v WHERE variant <= 4""")
def expand_keywords(spark, sf_dir):
    return expand.keywords(_asked(spark, *_KEYQ))


@entry(f"""WITH {_bm25(_ONE)}, h AS (SELECT r.num, regexp_split_to_array(t.text, chr(10)) AS ls FROM ranked r JOIN toks t USING (chunk_id) WHERE rank <= 10)
 SELECT num AS doc_num, 2 AS start_line, least(6, len(ls))::INT AS end_line, array_to_string(ls[2:least(6, len(ls))], chr(10)) AS text FROM h""")
def expand_lines(spark, sf_dir):
    chunks = _whole(spark, sf_dir)
    found = retrieval.bm25(_asked(spark, QUERY), chunks, 10, keep=("doc_id", "num"))
    hits = found.select("num", "doc_id", F.lit(4).alias("start_line"), F.lit(4).alias("end_line"))
    wide = expand.around(F.broadcast(hits), corpus.documents(spark, sf_dir), 2)
    return wide.select(F.col("num").alias("doc_num"), "start_line", "end_line", "text")


_B = "regexp_replace(regexp_extract({p}, '[^/]*$'), '\\.[^.]*$', '')"
_T = "(" + " OR ".join(f"contains({_B}, '{t}')" for t in expand.TEST_NAMES) + " OR " + " OR ".join(f"contains({{p}}, '{t}')" for t in expand.TEST_FOLDERS) + ")"


def _half(a: str, b: str) -> str:
    x, y = _B.format(p=a), _B.format(p=b)
    n = f"least(strlen({x}), strlen({y}))"
    return f"({n} >= 4 AND regexp_replace({a}, '/?[^/]*$', '') = regexp_replace({b}, '/?[^/]*$', '') AND substr({x}, 1, {n} // 2) = substr({y}, 1, {n} // 2))"


@entry(f"""WITH p(path) AS (VALUES {', '.join(f"('{x}')" for x in PATHS)}), l AS (SELECT path, coalesce(MAP {{{_MAP}}}[regexp_extract(path, '\\.[^./]*$')], 'unknown') AS lang FROM p)
 SELECT a.path AS path, b.path AS related FROM l a JOIN l b ON a.path <> b.path WHERE
   ({_T.format(p='b.path')} AND NOT {_T.format(p='a.path')} AND contains({_B.format(p='b.path')}, {_B.format(p='a.path')}))
   OR (NOT {_T.format(p='b.path')} AND {_T.format(p='a.path')} AND contains({_B.format(p='a.path')}, {_B.format(p='b.path')}))
   OR {_half('a.path', 'b.path')}
   OR (a.lang = 'go' AND b.lang = 'go' AND ({' OR '.join(f"contains(regexp_extract(b.path, '[^/]*$'), '{t}')" for t in expand.CONTRACT_NAMES)}))""")
def related_docs(spark, sf_dir):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string").withColumn("lang", tx.detect_language("path"))
    other = F.broadcast(paths.select(F.col("path").alias("related"), F.col("lang").alias("other_lang")))
    found = paths.join(other, (F.col("path") != F.col("related")) & expand.is_related(F.col("path"), F.col("lang"), F.col("related"), F.col("other_lang")))
    return found.select("path", "related")


# --- maintenance and quality ------------------------------------------------------------


@entry("""WITH old AS (SELECT doc_id, doc_id % 60 AS day FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, doc_id % 60 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS day FROM documents WHERE doc_id % 11 <> 0)
 SELECT coalesce(old.doc_id, new.doc_id) AS num, CASE WHEN new.doc_id IS NULL THEN 'delete' WHEN old.doc_id IS NULL THEN 'insert' WHEN old.day >= new.day THEN 'skip' ELSE 'update' END AS status
 FROM old FULL OUTER JOIN new ON old.doc_id = new.doc_id""")
def incremental_diff(spark, sf_dir):
    """Two made-up snapshots of the corpus: some documents gone, some new, some touched."""
    docs = corpus.documents(spark, sf_dir).select("num", "path", "mod_time")
    old = docs.where("num % 7 <> 0")
    touched = F.when(F.col("num") % 5 == 0, F.col("mod_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mod_time"))
    new = docs.where("num % 11 <> 0").withColumn("mod_time", touched)
    return index.incremental_diff(old, new).join(docs.select("path", "num"), "path").select("num", "status")


@entry(f"""WITH {_bm25(_BENCH)}, top AS (SELECT query_id, num, rank FROM ranked WHERE rank <= 10), g AS (SELECT t.query_id, t.rank, coalesce(l.quality, 0) AS gain FROM top t LEFT JOIN labels l ON l.doc_id = t.num
), got AS (SELECT query_id, sum((gain > 0)::INT) AS hits, count(*) AS n, min(CASE WHEN gain > 0 THEN rank END) AS first, sum(gain / log2(rank + 1)) AS dcg FROM g GROUP BY query_id
), rel AS (SELECT sum((quality > 0)::INT) AS relevant FROM labels
), best AS (SELECT sum(quality / log2(r + 1)) AS ideal FROM (SELECT quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS r FROM labels) WHERE r <= 10)
SELECT query_id, round(hits::DOUBLE / n, 6) AS precision, round(hits::DOUBLE / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(dcg / ideal, 6) AS ndcg FROM got CROSS JOIN rel CROSS JOIN best""")
def eval_metrics(spark, sf_dir):
    """Every labelled document is judged for every benchmark query, by its quality."""
    chunks = _whole(spark, sf_dir)
    asked = _benchmark(spark, sf_dir)
    found = retrieval.bm25(asked, chunks, 10, keep=("num",)).select("query_id", F.col("num").alias("item"), "rank")
    labels = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality").alias("gain"))
    return metrics.evaluate_shared(found, labels, 10).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")])


@entry(f"""WITH {_COSTOP}, t AS (SELECT * FROM tops WHERE rank <= 5)
 SELECT query_id, count(*) AS n_results, round(avg(score), 6) AS avg_score, round(max(score), 6) AS top_score,
  CASE WHEN avg(score) > 0.5 THEN 'GOOD' WHEN avg(score) > 0.3 THEN 'OK' ELSE 'POOR' END AS verdict,
  string_agg(CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.5 THEN 'GOOD' WHEN score > 0.3 THEN 'OK' ELSE 'LOW' END, ' ' ORDER BY rank) AS ratings FROM t GROUP BY query_id""")
def quality_report(spark, sf_dir):
    found = retrieval.vector_top(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5)
    rated = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", metrics.rating("score").alias("r")))), lambda x: x["r"]), " ").alias("ratings"))
    report = metrics.quality(found).join(rated, "query_id")
    return report.select("query_id", "n_results", F.round("avg_score", 6).alias("avg_score"), F.round("top_score", 6).alias("top_score"), "verdict", "ratings")


@entry(f"""WITH {_DOCS} SELECT t.total AS total_tokens, round(100 * (1 - 4000 / t.total::DOUBLE), 6) AS saved_percent, round(t.total / 1e6 * 0.15, 9) AS full_cost, round(4000 / 1e6 * 0.15 + 500 / 1e6 * 0.6, 9) AS cost
 FROM (SELECT (sum(strlen(text)) // 4)::BIGINT AS total FROM docs) t""")
def savings_report(spark, sf_dir):
    total = index.content_stats(_whole(spark, sf_dir)).select("total_tokens", F.lit(4000).alias("sent_tokens"), F.lit(500).alias("answer_tokens"))
    return metrics.savings(total).select("total_tokens", F.round("saved_percent", 6).alias("saved_percent"), F.round("full_cost", 9).alias("full_cost"), F.round("cost", 9).alias("cost"))


@entry(f"""WITH {_bm25(f"(SELECT * FROM (VALUES (0::BIGINT, '{QUERY}'), (1, '{REPEATED}')) t(query_id, text))")}, f AS (
  SELECT 0::BIGINT AS query_id, chunk_id, num, round(sum(1 / (60 + rank)), 9) AS score FROM ranked WHERE rank <= 50 GROUP BY chunk_id, num
), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM f)
SELECT query_id, num AS doc_num, round(score, 6) AS score, rank FROM o WHERE rank <= 10""")
def rank_fusion(spark, sf_dir):
    """Two questions' rankings as one."""
    chunks = _whole(spark, sf_dir)
    found = retrieval.bm25(_asked(spark, QUERY, REPEATED), chunks, 50).withColumn("query_id", F.lit(0).cast("long"))
    asked = _asked(spark, QUERY)
    best = retrieval.top(retrieval.reciprocal_ranks(found).withColumn("score", F.round("score", 9)), 10)
    return _shown(retrieval.with_columns_of(best, chunks, asked, 10, "num"))


from corvane.plans import catalog_code, catalog_engine, catalog_store  # noqa: E402, F401  they add their entries
