"""Queries of whole passes: sync with vectors, re-embedding, migration, and questions from memory to answer.

Stand-ins: documents are files with a short text and, but for English ones, frontmatter; every third has no text below it.
Embedder and models are plain columns here, so that SQL can state the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import chunks, evaluation, lexical, memory, retrieval, review, sync, tasks
from tessella.operators.vectors import knn
from tessella.plans.tables import NOW, THEN, _at, _documents, _grades, _items, _messages, _read, _shown, _stored, _time, _today, _told
from tessella.plans.tables_sql import _GRADE, _ITEMS, _LINE, _MESSAGES, _NEXT, _NL, _STORED, _TIMES
from tessella.schemas import CHUNKS, DOCUMENTS, TASKS, conform
from tessella.sources.workspace import fresh, written


def vector_topk_ties(spark, sf_dir):
    """Vectors of a few values only, so that most distances are equal and the keys decide; every hundredth is asked, every tenth of those without a vector."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.array((F.col("label") % 3).cast("float"), (F.col("vec_id") % 2).cast("float")).alias("embedding"), F.when(F.col("vec_id") % 7 > 0, F.col("label")).alias("label"))
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 1000 > 0, F.col("embedding")).alias("vector"), "label")
    near = knn(asked, v, 9, key="vec_id", vector="embedding").withColumn("matched", F.lit(False)).unionByName(knn(asked, v, 9, match="label", key="vec_id", vector="embedding").withColumn("matched", F.lit(True)))
    return near.select("query_id", "key", "distance", F.col("rank").cast("long").alias("rank"), "matched")


def _vector(c):
    """A text as three small numbers."""
    return F.array((F.length(c) % 7).cast("float"), F.ascii(c).cast("float"), (F.length(F.regexp_replace(c, "[^aeiou]", "")) % 5).cast("float"))


def _files(spark, sf_dir) -> DataFrame:
    d = _documents(spark, sf_dir)
    head = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("---\ntitle: Of "), "source", F.lit("\ntags: [a, b]\n---\n")))
    d = d.withColumn("text", F.when(F.col("doc_id") % 17 > 0, F.concat(head, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Word "), "source")))))
    return d.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.octet_length("text").cast("long").alias("file_size"), F.sha2(F.coalesce("text", F.lit("bad")), 256).alias("file_hash"), _at(NOW).alias("modified_at"), "text", F.when(F.col("doc_id") % 17 == 0, "can't be read").alias("error"))


def _old_chunks(spark, sf_dir) -> DataFrame:
    return conform(_stored(spark, sf_dir).select("file_path", F.lit(0).alias("chunk_index"), F.concat(F.lit("old "), "file_path").alias("content")), CHUNKS)


def _synced(spark, sf_dir) -> dict:
    return sync.sync(_files(spark, sf_dir), _stored(spark, sf_dir), _old_chunks(spark, sf_dir), _at(NOW), embed=_vector)


def sync_documents(spark, sf_dir):
    out = conform(_synced(spark, sf_dir)["documents"], DOCUMENTS)
    return _shown(out).join(out.select("file_path", "title", "tags"), "file_path")


def _numbers(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), "content", "chunk_strategy", "title", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])


def sync_chunks(spark, sf_dir):
    return _numbers(_synced(spark, sf_dir)["chunks"])


def _synced_texts(spark, sf_dir) -> dict:
    """A pass over the documents' whole texts as files, beside the stored ones."""
    d = _documents(spark, sf_dir)
    disk = d.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("file_hash"), _at(NOW).alias("modified_at"), "text", F.lit(None).cast("string").alias("error"))
    return sync.sync(disk, _stored(spark, sf_dir), _old_chunks(spark, sf_dir), _at(NOW), embed=None)


def sync_text_chunks(spark, sf_dir):
    return _synced_texts(spark, sf_dir)["chunks"].select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), "section_heading", "content", "chunk_strategy")


def sync_text_documents(spark, sf_dir):
    return conform(_synced_texts(spark, sf_dir)["documents"], DOCUMENTS).select("file_path", "file_hash", "chunk_count", "chunk_strategy", "status", _time("indexed_at"))


def reembed_chunks(spark, sf_dir):
    return _numbers(sync.reembed(_old_chunks(spark, sf_dir), _vector))


def migrate_documents(spark, sf_dir):
    return _shown(sync.migrate(_files(spark, sf_dir).filter("file_size % 2 = 0 or error is not null"), _stored(spark, sf_dir), _old_chunks(spark, sf_dir), _at(NOW), _vector)["documents"])


def rename_allowed(spark, sf_dir):
    """Even pages take a document's place, which is refused where that is stored; odd ones move."""
    to = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("doc/"), "page_id", F.lit(".md"))).otherwise(F.concat(F.lit("moved/"), "page_id", F.lit(".md")))
    renames = _read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("file_path"), to.alias("new_path"))
    return sync.rename(_stored(spark, sf_dir), _old_chunks(spark, sf_dir), renames)["documents"].select("file_path", "file_name", "file_hash", "status")


def review_series(spark, sf_dir):
    """All events of a user as reviews of the item of that id."""
    graded = _grades(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", "event_id", "grade")
    out = review.apply_reviews(_items(spark, sf_dir), graded, _today(), _at(NOW), ["ts", "event_id"])
    return out.select("id", "repetitions", F.round("easiness", 6).alias("easiness"), "interval", F.col("due_date").cast("string").alias("due_date"), _time("updated_at"))


def task_advance(spark, sf_dir):
    """A task for each source, those of three letters finished before; their log is that of the documents."""
    d = _documents(spark, sf_dir)
    log = d.select(F.col("source").alias("task_id"), "file_path", (F.col("lang") != "de").alias("done"), F.when(F.length("text") < 200, F.concat(F.lit("too short: "), "file_path")).alias("error"))
    held = d.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("total_files")).select("id", F.when(F.col("total_files") % 3 == 0, "failed").otherwise("pending").alias("status"), "total_files", F.lit(0).alias("processed_files"), _at(THEN).alias("created_at"))
    return tasks.advance(conform(held, TASKS), log, _at(NOW)).select("id", "status", "total_files", "processed_files", F.length("errors").cast("long").alias("error_chars"), _time("completed_at"))


# Questions


def _questions(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), "conv_id", F.concat(F.lit("and "), "conv_id", F.lit("?")).alias("question"))


def _rewriter(prompt):
    """Stands for a model: by the prompt's hash a comparison, a question, or no answer."""
    h = F.sha2(prompt, 256)
    return F.when(h < "6", F.concat(F.lit("compare "), F.substring(h, 1, 12))).when(h < "c", F.concat(F.lit("What is "), F.substring(h, 1, 12), F.lit(" good for?")))


def rewrite_route(spark, sf_dir):
    m = _messages(spark, sf_dir)
    asked = memory.rewrite(_questions(spark, sf_dir), m, _told(m), 4, ["conv_id"], _rewriter)
    return retrieval.variants(asked, imagine=lambda q: F.concat(F.lit("It is "), F.sha2(q, 256)), expand=lambda q: F.array(F.concat(q, F.lit(" more")), q)).select("query_id", "question", "strategy", F.col("variant_no").cast("long").alias("variant_no"), "variant")


def _parts(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part/"), F.col("p_partkey") % 50).alias("file_path"), F.floor(F.col("p_partkey") / 50).cast("int").alias("chunk_index"), F.concat("p_name", F.lit(" "), "p_type").alias("content"), F.col("p_brand").alias("pack_id")).withColumn("embedding", _vector(F.col("content")))


def _answers(spark, sf_dir) -> DataFrame:
    m = _messages(spark, sf_dir)
    return retrieval.answers(
        _questions(spark, sf_dir), _parts(spark, sf_dir), lambda c: F.when(F.sha2(c[1]["content"], 256) < "e", F.sha2(c[1]["content"], 256)), m, _told(m), 4, ["conv_id"], _rewriter,
        k=3, rerank_hits=True, embed=_vector, score=lambda q, c: (F.length(c) % 4).cast("double"), imagine=lambda q: F.concat(F.lit("It is "), F.sha2(q, 256)), expand=lambda q: F.array(F.concat(q, F.lit(" more")), q),
    )


def answer_pipeline(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "question", "strategy", F.array_join("sources", "|").alias("sources"), "answer", "error")


def bm25_prompts(spark, sf_dir):
    """The benchmark's items as questions: the documents' whole texts cut into chunks, ranked by words, put into prompts."""
    cut = written(chunks.fixed_chunks(_documents(spark, sf_dir)).withColumn("key", F.concat_ws("#", "file_path", "chunk_index")), "chunks")
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = written(lexical.search(lexical.build(cut, fresh(spark, "lexical"), "key", "content"), items), "hits").join(cut.select("key", "file_path", "content"), "key")
    return retrieval.prompts(items, hits.withColumn("ordinal", F.col("rank"))).select("query_id", F.col("messages")[1]["content"].alias("user"))


def eval_answers(spark, sf_dir):
    """The questions of an evaluation, matched with the answers by position, and the report."""
    q = evaluation.numbered(_questions(spark, sf_dir).select("query_id", "question", F.lit("yes").alias("ground_truth")), ["query_id"])
    results = _answers(spark, sf_dir).join(q.select("query_id", "no"), "query_id")
    scored = evaluation.evaluate(q, results, {"sourced": lambda df: F.when(df["n_sources"] > 2, 1.0).otherwise(0.0)})
    return evaluation.report(scored, ["answered", "n_sources", "sourced"])


QUERIES = {f.__name__: f for f in (vector_topk_ties, sync_documents, sync_chunks, sync_text_chunks, sync_text_documents, reembed_chunks, migrate_documents, rename_allowed, review_series, task_advance, rewrite_route, answer_pipeline, bm25_prompts, eval_answers)}

_FILES = f"""{_STORED}, files AS (
  SELECT doc_id, file_path, source, lang, doc_id % 17 = 0 AS bad, CASE WHEN lang = 'en' THEN '' ELSE '---' || {_NL} || 'title: Of ' || source || {_NL} || 'tags: [a, b]' || {_NL} || '---' || {_NL} END
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Word ' || source END AS text FROM docs),
f AS (SELECT *, octet_length(encode(text)) AS file_size, CASE WHEN bad THEN sha256('bad') ELSE sha256(text) END AS file_hash, split_part(file_path, '/', -1) AS file_name FROM files)"""
_DONE = """CASE WHEN bad THEN coalesce(s.file_size, NULL) ELSE f.file_size END AS file_size, CASE WHEN bad THEN s.file_hash ELSE f.file_hash END AS file_hash,
    CASE WHEN bad THEN coalesce(s.chunk_count, 0) ELSE (doc_id % 3 > 0)::BIGINT END AS chunk_count, CASE WHEN bad THEN 'error' ELSE 'indexed' END AS status, CASE WHEN bad THEN 'can''t be read' END AS error_message,
    CASE WHEN bad THEN s.chunk_strategy WHEN doc_id % 3 > 0 THEN 'heading-aware' ELSE 'fixed-split' END AS chunk_strategy"""
_MOMENTS = "TIMESTAMP '2024-02-01 00:00:00'"
_TIMED = f"CASE WHEN bad THEN coalesce(s.modified_at, {_MOMENTS}) ELSE {_MOMENTS} END AS modified_at, CASE WHEN bad THEN s.indexed_at ELSE {_MOMENTS} END AS indexed_at, coalesce(s.created_at, {_MOMENTS}) AS created_at, {_MOMENTS} AS updated_at"
_ALL = _TIMES("modified_at", "indexed_at", "created_at", "updated_at")
_V = lambda c: f"(length({c}) % 7)::DOUBLE AS v0, ascii({c})::DOUBLE AS v1, (length(regexp_replace({c}, '[^aeiou]', '', 'g')) % 5)::DOUBLE AS v2"
_CHANGED = "changed AS (SELECT f.* FROM f LEFT JOIN stored s USING (file_path) WHERE s.file_hash IS NULL OR s.file_hash <> f.file_hash)"
_HASH = "sha256(prompt)"
_FIXED = memory.REWRITE_TASK.replace("\n", "' || chr(10) || '")
_REWRITTEN = f"""{_MESSAGES}, r AS (SELECT conv_id, string_agg({_LINE}, {_NL} ORDER BY id) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS n FROM m) WHERE n <= 4 GROUP BY conv_id),
p AS (SELECT conv_id AS query_id, 'and ' || conv_id || '?' AS asked, sha256('{_FIXED}' || CASE WHEN last_message_id IS NULL THEN '' ELSE 'Earlier conversation summaries:' || {_NL} || 'told ' || conv_id || {_NL} || {_NL} END
  || 'Conversation history:' || {_NL} || recent || {_NL} || {_NL} || 'Follow-up question: and ' || conv_id || '?' || {_NL} || {_NL} || 'Standalone question:') AS h FROM r LEFT JOIN told USING (conv_id)),
q AS (SELECT query_id, CASE WHEN h < '6' THEN 'compare ' || h[1:12] WHEN h < 'c' THEN 'What is ' || h[1:12] || ' good for?' ELSE asked END AS question,
  CASE WHEN h < '6' THEN 'multi_query' WHEN h < 'c' THEN 'hyde' ELSE 'none' END AS strategy FROM p),
v AS (
  SELECT query_id, question, strategy, 0 AS variant_no, CASE strategy WHEN 'hyde' THEN 'It is ' || sha256(question) WHEN 'multi_query' THEN question || ' more' ELSE question END AS variant FROM q
  UNION ALL SELECT query_id, question, strategy, 1, question FROM q WHERE strategy = 'multi_query')"""
_ANSWERED = f"""{_REWRITTEN}, c AS (SELECT 'part/' || p_partkey % 50 AS file_path, (p_partkey // 50)::INTEGER AS chunk_index, p_name || ' ' || p_type AS content FROM part),
cv AS (SELECT *, {_V('content')} FROM c), vv AS (SELECT *, {_V('variant')} FROM v),
d AS (SELECT query_id, question, variant_no, file_path, chunk_index, content, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY (vv.v0 - cv.v0) ** 2 + (vv.v1 - cv.v1) ** 2 + (vv.v2 - cv.v2) ** 2, file_path, chunk_index) AS rank FROM vv, cv),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, chunk_index ORDER BY variant_no, rank) AS n FROM d WHERE rank <= 3),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, rank) AS ordinal FROM o WHERE n = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(content) % 4 DESC, ordinal) AS place FROM e),
u AS (SELECT * FROM t WHERE place <= 5),
s AS (SELECT query_id, string_agg(file_path, '|' ORDER BY first) AS sources, count(*) AS n_sources FROM (SELECT query_id, file_path, min(place) AS first FROM u GROUP BY ALL) GROUP BY query_id),
x AS (SELECT query_id, string_agg('[Source: ' || file_path || ']' || {_NL} || content, {_NL} || {_NL} ORDER BY place) AS context FROM u GROUP BY query_id),
a AS (SELECT query_id, question, strategy, sources, n_sources, sha256('Context from knowledge base:' || {_NL} || {_NL} || context || {_NL} || {_NL} || 'Question: ' || question) AS h FROM q JOIN s USING (query_id) JOIN x USING (query_id))"""

ORACLES = {
    "vector_topk_ties": """
WITH v AS (SELECT vec_id, label % 3 AS x, vec_id % 2 AS y, CASE WHEN vec_id % 7 > 0 THEN label END AS label FROM embeddings), q AS (SELECT vec_id AS query_id, x, y, label FROM v WHERE vec_id % 100 = 0 AND vec_id % 1000 > 0),
d AS (SELECT query_id, vec_id AS key, ((q.x - v.x) ** 2 + (q.y - v.y) ** 2)::DOUBLE AS distance, q.label = v.label AS same FROM q, v),
a AS (SELECT query_id, key, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, false AS matched FROM d),
b AS (SELECT query_id, key, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, true AS matched FROM d WHERE same)
SELECT * FROM a WHERE rank <= 9 UNION ALL SELECT * FROM b WHERE rank <= 9""",
    "sync_documents": f"""
WITH {_FILES}, {_CHANGED}, u AS (
  SELECT f.file_path, f.file_name, {_DONE}, {_TIMED}, CASE WHEN NOT bad AND lang <> 'en' THEN 'Of ' || source END AS title, CASE WHEN NOT bad AND lang <> 'en' THEN 'a,b' END AS tags FROM changed f LEFT JOIN stored s USING (file_path)
  UNION ALL SELECT file_path, file_name, file_size, file_hash, chunk_count, status, error_message, chunk_strategy, modified_at, indexed_at, created_at, updated_at, NULL, NULL FROM stored s WHERE EXISTS (SELECT 1 FROM f WHERE f.file_path = s.file_path AND f.file_hash = s.file_hash))
SELECT file_path, file_name, file_size, file_hash, chunk_count, status, error_message, chunk_strategy, title, tags, {_ALL} FROM u""",
    "sync_chunks": f"""
WITH {_FILES}, {_CHANGED}
SELECT file_path, 0::BIGINT AS chunk_index, 'Word ' || source AS content, 'heading-aware' AS chunk_strategy, CASE WHEN lang <> 'en' THEN 'Of ' || source END AS title, {_V("('Word ' || source)")} FROM changed WHERE NOT bad AND doc_id % 3 > 0
UNION ALL SELECT s.file_path, 0, 'old ' || s.file_path, NULL, NULL, NULL, NULL, NULL FROM stored s JOIN f USING (file_path) WHERE bad OR s.file_hash = f.file_hash""",
    "reembed_chunks": f"WITH {_STORED} SELECT file_path, 0::BIGINT AS chunk_index, 'old ' || file_path AS content, NULL::VARCHAR AS chunk_strategy, NULL::VARCHAR AS title, {_V("('old ' || file_path)")} FROM stored",
    "migrate_documents": f"""
WITH {_FILES}, k AS (SELECT * FROM f WHERE bad OR file_size % 2 = 0), old AS (SELECT * FROM stored WHERE chunk_strategy IS NULL AND status = 'indexed'), u AS (
  SELECT s.file_path, s.file_name, {_DONE}, {_TIMED} FROM old s JOIN k f USING (file_path)
  UNION ALL SELECT file_path, file_name, file_size, file_hash, chunk_count, 'error', 'the file is gone', chunk_strategy, modified_at, indexed_at, created_at, {_MOMENTS} FROM old WHERE file_path NOT IN (SELECT file_path FROM k)
  UNION ALL SELECT file_path, file_name, file_size, file_hash, chunk_count, status, error_message, chunk_strategy, modified_at, indexed_at, created_at, updated_at FROM stored WHERE file_path NOT IN (SELECT file_path FROM old))
SELECT file_path, file_name, file_size, file_hash, chunk_count, status, error_message, chunk_strategy, {_ALL} FROM u""",
    "rename_allowed": f"""
WITH {_STORED}, r AS (SELECT 'page/' || page_id AS file_path, CASE WHEN page_id % 2 = 0 THEN 'doc/' ELSE 'moved/' END || page_id || '.md' AS new_path FROM pages)
SELECT CASE WHEN ok THEN new_path ELSE file_path END AS file_path, CASE WHEN ok THEN split_part(new_path, '/', -1) ELSE file_name END AS file_name, file_hash, status
FROM (SELECT stored.*, new_path, coalesce(new_path NOT IN (SELECT file_path FROM stored), false) AS ok FROM stored LEFT JOIN r USING (file_path))""",
    "review_series": f"""
WITH RECURSIVE {_ITEMS}, e AS (SELECT user_id AS id, ({_GRADE})::DOUBLE AS grade, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
s AS (SELECT id, 0::BIGINT AS no, repetitions, easiness, interval, due_date, updated_at FROM items
  UNION ALL SELECT s.id, e.no, {_NEXT[0]}, {_NEXT[1]}, {_NEXT[2]}, due_date, updated_at FROM s JOIN e ON e.id = s.id AND e.no = s.no + 1),
l AS (SELECT * FROM s QUALIFY no = max(no) OVER (PARTITION BY id))
SELECT id, repetitions, round(easiness, 6) AS easiness, interval, CASE WHEN no > 0 THEN DATE '2024-01-20' + interval::INTEGER ELSE due_date END::VARCHAR AS due_date, strftime(CASE WHEN no > 0 THEN {_MOMENTS} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM l""",
    "task_advance": f"""
WITH d AS (SELECT source AS id, count(*) AS total_files, count(*) FILTER (lang <> 'de') AS n, string_agg('too short: doc/' || doc_id || '.md', {_NL}) FILTER (length(coalesce(text, '')) < 200) AS e FROM documents GROUP BY source)
SELECT id, total_files, CASE WHEN total_files % 3 = 0 THEN 'failed' WHEN n < total_files THEN 'running' WHEN e IS NOT NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN total_files % 3 = 0 THEN 0 ELSE n END AS processed_files,
  CASE WHEN total_files % 3 > 0 THEN length(e) END AS error_chars, CASE WHEN total_files % 3 > 0 AND n = total_files THEN '2024-02-01 00:00:00' END AS completed_at FROM d""",
    "rewrite_route": f"WITH {_REWRITTEN} SELECT query_id, question, strategy, variant_no::BIGINT AS variant_no, variant FROM v",
    "answer_pipeline": f"WITH {_ANSWERED} SELECT query_id, question, strategy, sources, CASE WHEN h < 'e' THEN h END AS answer, CASE WHEN h >= 'e' THEN 'the model gave no answer' END AS error FROM a",
    "eval_answers": f"WITH {_ANSWERED} SELECT count(*) AS questions, round(avg((h < 'e')::INTEGER), 4) AS answered, round(avg(n_sources), 4) AS n_sources, round(avg((n_sources > 2)::INTEGER), 4) AS sourced FROM a",
}
