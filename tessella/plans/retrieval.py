"""Queries of the retrieval operators. Vectors stand for chunks, labels for their packs, every hundredth vector is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.models import or_else
from tessella.functions.text import classify_strategy
from tessella.operators import embedder, evaluation, lexical, retrieval, vector_index
from tessella.operators.vectors import knn
from tessella.sources.workspace import fresh, written

EVERY = 100
CONDITION = {"$and": [{"label": {"$in": [1, 2, 3, 4]}}, {"vec_id": {"$gte": 50}}]}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label"))


def _hits(spark: SparkSession, sf_dir: str, k: int = 5, **how) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return knn(_asked(v), v, k, key="vec_id", vector="embedding", **how)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "key", F.col("rank").cast("long").alias("rank"), (F.round("distance", 6) + 0.0).alias("distance"))


def vector_topk(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir))


def vector_topk_cosine(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, metric="cosine"))


def vector_topk_ip(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, metric="ip"))


def vector_topk_same_pack(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, match="label"))


def vector_topk_where(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, condition=CONDITION))


def vector_topk_indexed(spark, sf_dir):
    """The same by a fresh index; no share of blocks is too large for it here."""
    v = _vectors(spark, sf_dir)
    index = vector_index.build(v, fresh(spark, "index"), "vec_id", "embedding")
    return _rounded(vector_index.search(index, _asked(v), share=1.0))


def _lexical(spark, sf_dir):
    return lexical.build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fresh(spark, "lexical"), "doc_id", "text")


def bm25_topk(spark, sf_dir):
    """The benchmark's items as questions to all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return lexical.search(_lexical(spark, sf_dir), items).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


def bm25_rerank(spark, sf_dir):
    """Twenty hits reranked by the words that they share with the question: vectors stand for the documents of their id."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    pairs = _hits(spark, sf_dir, 20).select("query_id", "key", F.col("rank").alias("ordinal")).join(texts, "query_id")
    return retrieval.rerank(lexical.scores(_lexical(spark, sf_dir), pairs), F.col("score")).select("query_id", "key", "score", F.col("ordinal").cast("long").alias("ordinal"))


def embedded_topk(spark, sf_dir):
    """All documents with vectors fitted to them; every hundredth is asked."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    embed = embedder.embed_column(spark, embedder.fit(docs, "text"))
    placed = written(docs.select("doc_id", embed(F.col("text")).alias("vector")), "placed")  # read by each block of queries
    asked = placed.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "vector")
    return _rounded(knn(asked, placed, key="doc_id"))


def multi_query_fusion(spark, sf_dir):
    """Three variants of a question (its vector, reversed, negated), pooled; a chunk counts once, where it came first."""
    v = _vectors(spark, sf_dir)
    negated = F.transform("vector", lambda x: -x)
    variants = F.array("vector", F.reverse("vector"), negated)
    asked = _asked(v).select("query_id", F.posexplode(variants).alias("variant_no", "vector")).select((F.col("query_id") * 10 + F.col("variant_no")).alias("query_id"), "vector")
    near = knn(asked, v, 5, key="vec_id", vector="embedding").select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("variant_no"), "key", "rank")
    return retrieval.first_wins(near, ["key"], ["variant_no", "rank"]).select("query_id", "key", "variant_no", F.col("rank").cast("long").alias("rank"), F.col("ordinal").cast("long").alias("ordinal"))


def _labelled(spark, sf_dir, k: int = 5) -> DataFrame:
    labels = _vectors(spark, sf_dir).select(F.col("vec_id").alias("key"), "label")
    return _hits(spark, sf_dir, k).join(labels, "key").withColumn("ordinal", F.col("rank"))


def rerank_topk(spark, sf_dir):
    """Twenty hits reranked by the label of the chunk, five stay."""
    out = retrieval.rerank(_labelled(spark, sf_dir, 20), F.col("label").cast("double"))
    return out.select("query_id", "key", "rerank_score", F.col("ordinal").cast("long").alias("ordinal"))


def _pathed(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).select("query_id", "ordinal", F.concat(F.lit("pack/"), "label").alias("file_path"), F.concat(F.lit("chunk "), "key").alias("content"))


def retrieval_sources(spark, sf_dir):
    out = retrieval.sources(_pathed(spark, sf_dir))
    return out.select("query_id", "file_path", F.col("place").cast("long").alias("place"))


def retrieval_context(spark, sf_dir):
    return retrieval.context(_pathed(spark, sf_dir))


def retrieval_prompts(spark, sf_dir):
    """Every vector is a question; those that aren't asked have no context."""
    questions = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("what is "), "vec_id", F.lit("?")).alias("question"))
    out = retrieval.prompts(questions, _pathed(spark, sf_dir), "Be brief.")
    return out.select("query_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


def query_strategy(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select((-1 - F.col("item_id")).alias("id"), F.concat(F.lit("What is "), "text", F.lit("?")).alias("text"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.lit(-1_000_000) - F.col("p_partkey")).alias("id"), F.concat("p_name", F.lit(" versus "), "p_type").alias("text"))
    return talks.unionByName(items).unionByName(parts).select("id", classify_strategy("text").alias("strategy"))


def model_fallback(spark, sf_dir):
    """A model's answer, here the text after the first colon, or the question where it is blank."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", or_else(lambda c: F.regexp_extract(c, r"(?s)^[^:]*:([^:]*)", 1), F.coalesce("text", F.lit("")), F.concat(F.lit("document "), "doc_id")).alias("answer"))


def _scores(spark, sf_dir) -> DataFrame:
    own = _asked(_vectors(spark, sf_dir)).select("query_id", F.col("label").alias("wanted"))
    hits = _labelled(spark, sf_dir).filter("key <> query_id").join(own, "query_id")
    return evaluation.question_scores(hits.withColumn("relevant", F.col("label") == F.col("wanted")))


def eval_questions(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


def eval_report(spark, sf_dir):
    return evaluation.report(_scores(spark, sf_dir), ["hit", "n_relevant", "reciprocal_rank"])


def eval_accepted(spark, sf_dir):
    return evaluation.accepted(_scores(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_cosine, vector_topk_ip, vector_topk_same_pack, vector_topk_where, vector_topk_indexed, bm25_topk, bm25_rerank, embedded_topk, multi_query_fusion, rerank_topk, retrieval_sources, retrieval_context,
    retrieval_prompts, query_strategy, model_fallback, eval_questions, eval_report, eval_accepted,
)}

_L2 = "list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


def _topk(distance: str, k: int = 5, condition: str = "true") -> str:
    return f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label AS wanted FROM embeddings WHERE vec_id % {EVERY} = 0),
d AS (SELECT query_id, wanted, vec_id AS key, label, {distance} AS distance FROM q, (SELECT *, embedding::DOUBLE[] AS b FROM embeddings) WHERE {condition}),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM d) WHERE rank <= {k})"""


def _ranked(*how) -> str:
    return f"WITH {_topk(*how)} SELECT query_id, key, rank, round(distance, 6) + 0.0 AS distance FROM h"


_HITS = _topk(_L2)
_SCORES = f"""WITH {_HITS}, s AS (
  SELECT query_id, max((label = wanted)::INTEGER) AS hit, count(*) FILTER (label = wanted) AS n_relevant, coalesce(1.0::DOUBLE / min(rank) FILTER (label = wanted), 0) AS reciprocal_rank
  FROM h WHERE key <> query_id GROUP BY query_id)"""
_CONTEXT = f"{_HITS}, c AS (SELECT query_id, string_agg('[Source: pack/' || label || ']' || chr(10) || 'chunk ' || key, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id)"
_SPACE = r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]"
_quoted = lambda words: "|".join(words).replace(r"\s", _SPACE)


def _strategy_sql() -> str:
    from tessella.functions import text as t

    return rf"""
WITH a AS (
  SELECT conv_id * 100000 + turn AS id, text FROM conversations UNION ALL SELECT -1 - item_id, 'What is ' || text || '?' FROM benchmark
  UNION ALL SELECT -1000000 - p_partkey, p_name || ' versus ' || p_type FROM part
), b AS (SELECT id, regexp_replace(coalesce(text, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS s FROM a),
c AS (SELECT id, s, length(regexp_replace(s, '[^一-鿿]', '', 'g')) > length(s) / 3 AS cjk, s LIKE '%?' OR s LIKE '%？' AS asks, len(regexp_split_to_array(s, '{_SPACE}+')) AS n FROM b)
SELECT id, CASE WHEN s = '' THEN 'none'
  WHEN regexp_matches(s, '(?i){_quoted(t.COMPARISONS)}') OR regexp_matches(s, '{_quoted(t.COMPARISONS_CN)}') THEN 'multi_query'
  WHEN NOT asks AND CASE WHEN cjk THEN length(replace(s, ' ', '')) <= 8 ELSE n <= 4 END THEN 'multi_query'
  WHEN regexp_matches(s, '(?i){_quoted(t.QUESTIONS)}') OR regexp_matches(s, '{_quoted(t.QUESTIONS_CN)}') THEN 'hyde'
  WHEN asks AND (cjk OR n >= 5) THEN 'hyde' ELSE 'none' END AS strategy
FROM c"""


_BM25 = f"""
w AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents), c AS (SELECT key, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT key, sum(tf) AS length FROM c GROUP BY key), a AS (SELECT count(*) AS n, avg(length) AS mean FROM l), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
p AS (SELECT term, key, floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {lexical.K1 + 1}::DOUBLE / (tf + {lexical.K1}::DOUBLE * (1 - {lexical.B}::DOUBLE + {lexical.B}::DOUBLE * length / mean))) * {lexical.UNIT} + 0.5)::BIGINT AS score FROM c JOIN l USING (key) JOIN f USING (term), a),
bq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
s AS (SELECT query_id, key, sum(score)::BIGINT AS score FROM bq JOIN p USING (term) GROUP BY ALL)"""

ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5",
    "bm25_rerank": f"""
WITH {_topk(_L2, 20)}, {_BM25.replace("FROM benchmark", "FROM documents WHERE doc_id IN (SELECT query_id FROM h)").replace("item_id", "doc_id")},
e AS (SELECT query_id, key, rank, coalesce(score, 0) AS score FROM h LEFT JOIN s USING (query_id, key) WHERE query_id IN (SELECT doc_id FROM documents))
SELECT query_id, key, score, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS ordinal FROM e) WHERE ordinal <= 5""",
    "vector_topk": _ranked(_L2),
    "vector_topk_indexed": _ranked(_L2),
    "vector_topk_cosine": _ranked(f"1 - {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')})"),
    "vector_topk_ip": _ranked(f"1 - {_DOT.format('a', 'b')}"),
    "vector_topk_same_pack": _ranked(_L2, 5, "label = wanted"),
    "vector_topk_where": _ranked(_L2, 5, "label IN (1, 2, 3, 4) AND vec_id >= 50"),
    "multi_query_fusion": f"""
WITH q AS (
  SELECT vec_id AS query_id, 0 AS variant_no, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % {EVERY} = 0
  UNION ALL SELECT vec_id, 1, list_reverse(embedding)::DOUBLE[] FROM embeddings WHERE vec_id % {EVERY} = 0
  UNION ALL SELECT vec_id, 2, list_transform(embedding::DOUBLE[], lambda x: -x) FROM embeddings WHERE vec_id % {EVERY} = 0
), d AS (SELECT query_id, variant_no, vec_id AS key, {_L2} AS distance FROM q, (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, key) AS rank FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY variant_no, rank) AS n FROM h WHERE rank <= 5)
SELECT query_id, key, variant_no::BIGINT AS variant_no, rank, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, rank) AS ordinal FROM f WHERE n = 1""",
    "rerank_topk": f"""
WITH {_topk(_L2, 20)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, rank) AS ordinal FROM h)
SELECT query_id, key, label::DOUBLE AS rerank_score, ordinal FROM r WHERE ordinal <= 5""",
    "retrieval_sources": f"""
WITH {_HITS}, s AS (SELECT query_id, 'pack/' || label AS file_path, min(rank) AS first FROM h GROUP BY ALL)
SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM s""",
    "retrieval_context": f"WITH {_CONTEXT} SELECT query_id, context FROM c",
    "retrieval_prompts": f"""
WITH {_CONTEXT}
SELECT vec_id AS query_id, '{retrieval.SYSTEM_PROMPT.replace("'", "''")}' || chr(10) || chr(10) || 'Be brief.' AS system,
  CASE WHEN context IS NULL THEN 'No relevant context was found in the knowledge base.' || chr(10) || chr(10) || 'Question: what is ' || vec_id || '?'
    ELSE 'Context from knowledge base:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: what is ' || vec_id || '?' END AS "user"
FROM embeddings LEFT JOIN c ON vec_id = query_id""",
    "query_strategy": _strategy_sql(),
    "model_fallback": rf"""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_extract(coalesce(text, ''), '(?s)^[^:]*:([^:]*)', 1), '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''), 'document ' || doc_id) AS answer FROM documents""",
    "eval_questions": f"{_SCORES} SELECT query_id, hit, n_relevant, round(reciprocal_rank, 6) AS reciprocal_rank FROM s",
    "eval_report": f"{_SCORES} SELECT count(*) AS questions, round(avg(hit), 4) AS hit, round(avg(n_relevant), 4) AS n_relevant, round(avg(reciprocal_rank), 4) AS reciprocal_rank FROM s",
    "eval_accepted": f"{_SCORES} SELECT round(avg(hit), 6) AS hit_rate, avg(hit) >= 0.8 AS accepted FROM s",
}
