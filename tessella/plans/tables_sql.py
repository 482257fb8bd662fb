"""DuckDB SQL of the queries in tables.py."""

from __future__ import annotations

from tessella.operators.memory import REWRITE_TASK

_SPACE = r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]"
_NL = "chr(10)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"



_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, 'doc/' || doc_id || '.md' AS file_path, lang, source FROM documents)"
_FRONTMATTER = f"'---' || {_NL} || 'title: Of ' || source || {_NL} || 'category: ' || lang || {_NL} || 'tags: [a, b]' || {_NL} || 'pack_id: p1' || {_NL} || '---' || {_NL}"
_MD = f"""{_DOCS}, md AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE {_FRONTMATTER} END || '# First' || {_NL} || replace(text, {_NL}, {_NL} || {_NL} || '## Next' || {_NL}) AS text FROM docs)"""
_TIMES = lambda *c: ", ".join(f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {x}" for x in c)
_ALL_TIMES = _TIMES("modified_at", "indexed_at", "created_at", "updated_at")
_THEN, _NOW = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"

_STORED = f"""{_DOCS}, disk AS (SELECT file_path, split_part(file_path, '/', -1) AS file_name, octet_length(encode(text)) AS file_size, sha256(text) AS file_hash, lang FROM docs),
stored AS (
  SELECT file_path, split_part(file_path, '/', -1) AS file_name, 7::BIGINT AS file_size, CASE WHEN quality = 1 THEN sha256(text) WHEN toxic = 0 THEN sha256(source) END AS file_hash, 3::BIGINT AS chunk_count,
    CASE WHEN toxic = 1 THEN 'error' ELSE 'indexed' END AS status, CASE WHEN toxic = 1 THEN 'bad file' END AS error_message, CASE WHEN lang = 'en' THEN 'heading-aware' END AS chunk_strategy,
    {_THEN} AS modified_at, {_THEN} AS indexed_at, {_THEN} AS created_at, {_THEN} AS updated_at FROM docs JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'page/' || page_id, page_id::VARCHAR, 7, sha256(url), 3, 'indexed', NULL, 'fixed-split', {_THEN}, {_THEN}, {_THEN}, {_THEN} FROM pages
), diff AS (
  SELECT coalesce(d.file_path, s.file_path) AS file_path, d.file_hash AS disk_hash, s.file_hash AS stored_hash,
    CASE WHEN s.file_path IS NULL THEN 'new' WHEN d.file_path IS NULL THEN 'deleted' WHEN d.file_hash IS NOT DISTINCT FROM s.file_hash THEN 'unchanged' ELSE 'modified' END AS change
  FROM disk d FULL JOIN stored s ON d.file_path = s.file_path)"""
_COLUMNS = f"file_path, file_name, file_size, file_hash, chunk_count, status, error_message, chunk_strategy, {_ALL_TIMES}"

_MESSAGES = """m AS (SELECT conv_id * 100000 + turn AS id, conv_id, role, coalesce(text, '') AS content FROM conversations),
told AS (SELECT conv_id, min(id) + 1 AS last_message_id FROM m GROUP BY conv_id HAVING count(*) >= 6),
open AS (SELECT m.* FROM m LEFT JOIN told USING (conv_id) WHERE id > coalesce(last_message_id, 0))"""
_LINE = "upper(role[1]) || lower(role[2:]) || ': ' || content"

_GRADE = "CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


def _sm2(q: str, n: str, e: str, i: str) -> tuple[str, str, str]:
    new = f"greatest(1.3::DOUBLE, {e} + (0.1::DOUBLE - (5.0::DOUBLE - {q}) * (0.08::DOUBLE + (5.0::DOUBLE - {q}) * 0.02::DOUBLE)))"
    return f"(CASE WHEN {q} < 2 THEN 0 ELSE {n} + 1 END)::BIGINT", new, f"(CASE WHEN {q} < 2 THEN 1 WHEN {n} = 0 THEN 1 WHEN {n} = 1 THEN 6 ELSE round_even({i} * {new}, 0) END)::BIGINT"


_STEP = _sm2("grade", "n", "e", "i")
_APPLY = _sm2("grade", "repetitions", "easiness", "interval")
_NEXT = _sm2("grade", "repetitions", "easiness", "interval")
_ITEMS = f"items AS (SELECT p_partkey AS id, p_name AS question, (p_size % 3)::BIGINT AS repetitions, 2.5::DOUBLE AS easiness, p_size::BIGINT AS interval, DATE '2024-01-01' + p_size AS due_date, {_THEN} AS updated_at FROM part)"
_PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS file_path FROM pages)"
_TREE = f"""{_PATHS}, parts AS (SELECT list_filter(string_split(file_path, '/'), lambda x: x <> '') AS p FROM paths),
nodes AS (SELECT p[:i] AS way, i < len(p) AS inside FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
tree AS (SELECT array_to_string(way, '/') AS node_path, array_to_string(way[:-2], '/') AS parent, way[-1] AS name, len(way) AS depth, CASE WHEN bool_or(inside) THEN 'directory' ELSE 'file' END AS type FROM nodes GROUP BY way)"""
_SUMMARIES = f"{_DOCS}, sums AS (SELECT file_path, 'about ' || source AS summary, {_THEN} AS created_at, {_THEN} AS updated_at FROM docs JOIN labels USING (doc_id))"
_HEAD = f"'(?m)^(#{{1,6}}){_SPACE}+(.+)$'"
_NUMBERED = f"'^\\p{{Nd}}+[.)]{_SPACE}*(.+)$'"
_FRONT = "'(?s)\\A---[ \\t]*\\r?\\n(.*?)---[ \\t]*\\r?\\n?'"

_REWRITE = REWRITE_TASK.replace("\n", "' || chr(10) || '")

ORACLES = {
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, octet_length(encode(coalesce(text, '')))::BIGINT AS file_size FROM documents",
    "text_measures": f"""
WITH {_DOCS}, s AS (SELECT doc_id, text, {_strip('text')} AS s, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS c FROM docs),
w AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '{_SPACE}+')) END AS n, c > length(text) / 3 AS cjk FROM s)
SELECT doc_id, length(s)::BIGINT AS stripped_chars, n::BIGINT AS n_words, c::BIGINT AS n_cjk, cjk AS is_cjk,
  s <> '' AND NOT (s LIKE '%?' OR s LIKE '%？') AND CASE WHEN length(regexp_replace(s, '[^一-鿿]', '', 'g')) > length(s) / 3 THEN length(replace(s, ' ', '')) <= 8 ELSE n <= 4 END AS is_short FROM w""",
    "frontmatter_split": f"""
WITH {_MD} SELECT doc_id, CASE WHEN regexp_matches(text, {_FRONT}) THEN regexp_extract(text, {_FRONT}, 1) END AS yaml,
  sha256(substr(text, 1 + length(regexp_extract(text, {_FRONT}, 0)))) AS body_sha256 FROM md""",
    "frontmatter_fields": "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'Of ' || source END AS title, CASE WHEN lang <> 'en' THEN lang END AS category, CASE WHEN lang <> 'en' THEN 'a,b' END AS tags, NULL::VARCHAR AS difficulty, CASE WHEN lang <> 'en' THEN 'p1' END AS pack_id FROM documents",
    "section_split": f"""
WITH {_MD}, s AS (SELECT doc_id, regexp_split_to_array(text, {_HEAD}) AS p, list_transform(regexp_extract_all(text, {_HEAD}, 2), lambda x: {_strip('x')}) AS h FROM md),
k AS (SELECT doc_id, p, h, {_strip('p[1]')} <> '' AS before FROM s)
SELECT doc_id, (len(h) + before::INTEGER)::BIGINT AS n_sections, CASE WHEN before THEN '|' ELSE '' END || array_to_string(h, '|') AS headings,
  sha256(array_to_string(CASE WHEN before THEN p ELSE p[2:] END, '|')) AS bodies_sha256 FROM k""",
    "section_spaces": f"""
WITH {_DOCS}, w AS (SELECT doc_id, replace(text, {_NL}, {_NL} || '##' || chr(12288) || 'Next' || chr(160) || 'part' || {_NL} || '#' || chr(160) || 'Other' || {_NL} || '####' || chr(8195) || chr(12288) || 'deep' || {_NL} || '#no' || {_NL}) AS text FROM docs),
s AS (SELECT doc_id, text, regexp_split_to_array(text, {_HEAD}) AS p, list_transform(regexp_extract_all(text, {_HEAD}, 2), lambda x: {_strip('x')}) AS h FROM w),
k AS (SELECT *, {_strip('p[1]')} <> '' OR len(h) = 0 AS before FROM s),
n AS (SELECT *, list_transform(string_split('1.' || chr(12288) || 'one' || {_NL} || chr(1634) || ') two' || {_NL} || text, {_NL}), lambda x: {_strip('x')}) AS l FROM k)
SELECT doc_id, (len(h) + before::INTEGER)::BIGINT AS n_sections, array_to_string(CASE WHEN before THEN list_prepend('', h) ELSE h END, '|') AS headings,
  sha256(array_to_string(CASE WHEN before THEN p ELSE p[2:] END, '|')) AS bodies_sha256,
  array_to_string(list_transform(list_filter(l, lambda x: regexp_matches(x, {_NUMBERED})), lambda x: {_strip(f"regexp_extract(x, {_NUMBERED}, 1)")}), '|') AS numbered FROM n""",
    "pdf_texts": f"""
WITH {_DOCS}, l AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, {_NL}) AS l FROM docs)),
p AS (SELECT doc_id, no // 40 AS page, string_agg(line || {_NL}, '' ORDER BY no) FILTER (line <> '') AS t FROM l GROUP BY ALL)
SELECT 'doc/' || doc_id || '.pdf' AS file_path, coalesce(string_agg(t, {_NL} ORDER BY page) FILTER (t IS NOT NULL), '') AS text, NULL::VARCHAR AS error FROM p GROUP BY doc_id""",
    "sections_merged": f"""
WITH RECURSIVE {_MD}, k AS (SELECT doc_id, regexp_split_to_array(text, {_HEAD}) AS p, list_transform(regexp_extract_all(text, {_HEAD}, 2), lambda x: {_strip('x')}) AS h FROM md),
l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS body, unnest(list_prepend('', h)) AS heading FROM k),
s AS (SELECT doc_id, heading, body, {_strip('body')} AS bare, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no FROM l WHERE i > 0 OR {_strip('body')} <> '' OR doc_id IN (SELECT doc_id FROM k WHERE len(h) = 0)),
g AS (  -- a section's outcome: the heading and text that wait after it, or the section that is done with it
  SELECT doc_id, 0::BIGINT AS no, '' AS wait_heading, '' AS wait, NULL::VARCHAR AS heading, NULL::VARCHAR AS body FROM k
  UNION ALL
  SELECT doc_id, no, CASE WHEN short THEN head ELSE '' END, CASE WHEN short THEN CASE WHEN waiting THEN joined ELSE bare END ELSE '' END, CASE WHEN NOT short THEN head END, CASE WHEN NOT short THEN CASE WHEN waiting THEN joined ELSE body END END
  FROM (SELECT *, length({_strip('joined')}) < 100 AS short FROM (SELECT s.*, g.wait <> '' AS waiting, CASE WHEN g.wait <> '' THEN g.wait_heading ELSE s.heading END AS head,
    CASE WHEN g.wait <> '' THEN regexp_replace(g.wait, '{_SPACE}+$', '') || {_NL} || {_NL} || s.bare ELSE s.bare END AS joined FROM g JOIN s ON s.doc_id = g.doc_id AND s.no = g.no + 1))),
d AS (SELECT doc_id, heading, body, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS no, count(*) OVER (PARTITION BY doc_id) AS n FROM g WHERE body IS NOT NULL),
w AS (SELECT doc_id, wait_heading, wait FROM g QUALIFY no = max(no) OVER (PARTITION BY doc_id))
SELECT doc_id, no::INTEGER AS no, heading, CASE WHEN no = n - 1 AND wait <> '' THEN regexp_replace(body, '{_SPACE}+$', '') || {_NL} || {_NL} || wait ELSE body END AS body FROM d JOIN w USING (doc_id)
UNION ALL SELECT doc_id, 0, wait_heading, wait FROM w WHERE wait <> '' AND doc_id NOT IN (SELECT doc_id FROM d)""",
    "numbered_variants": f"""
WITH {_DOCS}, l AS (SELECT doc_id, source, list_transform(string_split('intro' || {_NL} || '1. ' || replace(text, {_NL}, {_NL} || '  2) '), {_NL}), lambda x: {_strip('x')}) AS l FROM docs),
v AS (SELECT doc_id, source, list_transform(list_filter(l, lambda x: regexp_matches(x, {_NUMBERED})), lambda x: {_strip(f"regexp_extract(x, {_NUMBERED}, 1)")}) AS v FROM l),
w AS (SELECT doc_id, CASE WHEN list_contains(v, source) THEN v ELSE list_prepend(source, v) END AS v FROM v)
SELECT doc_id, len(v)::BIGINT AS n, sha256(array_to_string(v, '|')) AS variants_sha256 FROM w""",
    "path_parts": f"""
WITH {_PATHS}, e AS (SELECT *, lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) AS extension FROM paths)
SELECT page_id, split_part(file_path, '/', -1) AS base, regexp_replace(file_path, '/?[^/]*$', '') AS parent, extension, extension IN ('.md', '.pdf') AS ingestable, file_path <> '' AND NOT starts_with(file_path, '/') AS safe FROM e""",
    "snapshot_diff": f"WITH {_STORED} SELECT * FROM diff",
    "snapshot_diff_by_folder": f"WITH {_STORED} SELECT * FROM diff",
    "sync_counters": f"WITH {_STORED} SELECT count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted FROM diff",
    "ingest_status": f"WITH {_STORED} SELECT file_path, CASE WHEN change = 'unchanged' THEN 'skipped' ELSE 'indexed' END AS status FROM diff WHERE change <> 'deleted'",
    "document_upsert": f"""
WITH {_STORED}, done AS (SELECT disk.* FROM disk JOIN diff USING (file_path) WHERE change IN ('new', 'modified')), u AS (
  SELECT file_path, file_name, file_size, file_hash, 5 AS chunk_count, 'indexed' AS status, NULL::VARCHAR AS error_message, 'fixed-split' AS chunk_strategy, {_NOW} AS modified_at, {_NOW} AS indexed_at,
    coalesce((SELECT created_at FROM stored s WHERE s.file_path = done.file_path), {_NOW}) AS created_at, {_NOW} AS updated_at FROM done
  UNION ALL SELECT * FROM stored WHERE file_path NOT IN (SELECT file_path FROM done))
SELECT {_COLUMNS} FROM u""",
    "document_versions": f"""
WITH {_STORED}, done AS (SELECT disk.* FROM disk JOIN diff USING (file_path) WHERE change IN ('new', 'modified')), u AS (
  SELECT file_path, file_name, file_size, file_hash, 5 AS chunk_count, 'indexed' AS status, NULL::VARCHAR AS error_message, 'fixed-split' AS chunk_strategy, {_NOW} AS modified_at, {_NOW} AS indexed_at,
    coalesce((SELECT created_at FROM stored s WHERE s.file_path = done.file_path), {_NOW}) AS created_at, {_NOW} AS updated_at FROM done
  UNION ALL SELECT * FROM stored WHERE file_path NOT IN (SELECT file_path FROM done))
SELECT {_COLUMNS}, 1 AS version FROM u UNION ALL SELECT {_COLUMNS}, 0 FROM stored""",
    "document_errors": f"""
WITH {_STORED}, u AS (
  SELECT d.file_path, coalesce(s.file_name, d.file_name) AS file_name, s.file_size, s.file_hash, coalesce(s.chunk_count, 0) AS chunk_count, 'error' AS status, 'can''t be read' AS error_message, s.chunk_strategy,
    coalesce(s.modified_at, {_NOW}) AS modified_at, s.indexed_at, coalesce(s.created_at, {_NOW}) AS created_at, {_NOW} AS updated_at FROM disk d LEFT JOIN stored s USING (file_path) WHERE lang = 'de'
  UNION ALL SELECT * FROM stored WHERE file_path NOT IN (SELECT file_path FROM disk WHERE lang = 'de'))
SELECT {_COLUMNS} FROM u""",
    "document_delete": f"WITH {_STORED} SELECT {_COLUMNS} FROM stored WHERE file_path IN (SELECT file_path FROM disk)",
    "document_rename": f"""
WITH {_STORED}, u AS (SELECT * REPLACE (CASE WHEN starts_with(file_path, 'page/') THEN 'moved/' || file_name || '.md' ELSE file_path END AS file_path, CASE WHEN starts_with(file_path, 'page/') THEN file_name || '.md' ELSE file_name END AS file_name) FROM stored)
SELECT {_COLUMNS} FROM u""",
    "rename_conflicts": f"WITH {_STORED} SELECT 'page/' || page_id AS file_path, 'doc/' || page_id || '.md' AS new_path FROM pages WHERE 'doc/' || page_id || '.md' IN (SELECT file_path FROM stored)",
    "migrate_candidates": f"WITH {_STORED} SELECT file_path, status FROM stored WHERE chunk_strategy IS NULL AND status = 'indexed'",
    "history_page": f"WITH {_MESSAGES} SELECT id, role, (SELECT count(*) FROM m) AS total FROM m ORDER BY id LIMIT 50 OFFSET 25",
    "last_messages": f"WITH {_MESSAGES} SELECT conv_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS n FROM m) WHERE n <= 3",
    "unsummarised": f"WITH {_MESSAGES} SELECT conv_id, count(*) AS n FROM open GROUP BY conv_id",
    "compress_messages": f"""
WITH {_MESSAGES}, t AS (SELECT conv_id, count(*) AS n_messages, min(id) AS first_message_id, max(id) AS last_message_id, string_agg({_LINE}, {_NL} ORDER BY id) AS transcript FROM open GROUP BY conv_id)
SELECT *, sha256(transcript) AS summary FROM t WHERE n_messages >= 4""",
    "rewrite_prompts": f"""
WITH {_MESSAGES}, r AS (SELECT conv_id, string_agg({_LINE}, {_NL} ORDER BY id) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS n FROM m) WHERE n <= 4 GROUP BY conv_id)
SELECT conv_id, 'and ' || conv_id || '?' AS question, true AS has_context, '{_REWRITE}' || CASE WHEN last_message_id IS NULL THEN '' ELSE 'Earlier conversation summaries:' || {_NL} || 'told ' || conv_id || {_NL} || {_NL} END
  || 'Conversation history:' || {_NL} || recent || {_NL} || {_NL} || 'Follow-up question: and ' || conv_id || '?' || {_NL} || {_NL} || 'Standalone question:' AS prompt
FROM r LEFT JOIN told USING (conv_id)""",
    "export_chat": f"WITH {_MESSAGES} SELECT role, content, id AS at FROM m ORDER BY id",
    "review_step": f"""
WITH e AS (SELECT event_id, ({_GRADE})::DOUBLE AS grade, (user_id % 4)::BIGINT AS n, least(2.5::DOUBLE, 1.3::DOUBLE + value / 100.0::DOUBLE) AS e, user_id + 1 AS i FROM events)
SELECT event_id, {_STEP[0]} AS repetitions, {_STEP[1]} AS easiness, {_STEP[2]} AS interval FROM e""",
    "review_replay": f"""
WITH RECURSIVE e AS (SELECT user_id, ({_GRADE})::DOUBLE AS grade, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS no, 0::BIGINT AS repetitions, 2.5::DOUBLE AS easiness, 1::BIGINT AS interval FROM e
  UNION ALL SELECT s.user_id, e.no, {_NEXT[0]}, {_NEXT[1]}, {_NEXT[2]} FROM s JOIN e ON e.user_id = s.user_id AND e.no = s.no + 1)
SELECT user_id, no AS n_reviews, repetitions, easiness, interval FROM s QUALIFY no = max(no) OVER (PARTITION BY user_id)""",
    "review_apply": f"""
WITH {_ITEMS}, g AS (SELECT s_suppkey AS id, (s_nationkey % 5)::DOUBLE AS grade FROM supplier), a AS (
  SELECT items.id, {_APPLY[0]} AS repetitions, {_APPLY[1]} AS easiness, {_APPLY[2]} AS interval FROM items JOIN g USING (id))
SELECT id, repetitions, easiness, interval, (DATE '2024-01-20' + interval::INTEGER)::DATE::VARCHAR AS due_date, '2024-02-01 00:00:00' AS updated_at FROM a
UNION ALL SELECT id, repetitions, easiness, interval, due_date::DATE::VARCHAR, '2024-01-01 00:00:00' FROM items WHERE id NOT IN (SELECT id FROM g)""",
    "review_due": f"WITH {_ITEMS} SELECT id, question, due_date::DATE::VARCHAR AS due_date FROM items WHERE due_date <= DATE '2024-01-20' ORDER BY due_date, id",
    "review_stats": f"WITH {_ITEMS} SELECT count(*) AS total, count(*) FILTER (due_date <= DATE '2024-01-20') AS due_today FROM items",
    "knowledge_tree": f"WITH {_TREE} SELECT node_path, parent, name, depth::BIGINT AS depth, type FROM tree",
    "tree_files": f"WITH {_TREE} SELECT node_path FROM tree WHERE type = 'file'",
    "catalog_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%size 1%' OR p_type ILIKE '%size 1%' OR p_brand ILIKE '%size 1%' OR 'size ' || p_size ILIKE '%size 1%' UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%'",
    "catalog_imported": "SELECT n_nationkey, n_name, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9970) AS imported FROM nation",
    "catalog_import": "SELECT s_nationkey AS n_nationkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9970)",
    "task_rollup": f"""
WITH {_DOCS}, l AS (SELECT source AS task_id, file_path, lang <> 'de' AS done, CASE WHEN length(text) < 200 THEN 'too short: ' || file_path END AS error FROM docs),
c AS (SELECT task_id, count(*) AS total_files, count(*) FILTER (done) AS processed_files, string_agg(error, {_NL} ORDER BY file_path) FILTER (error IS NOT NULL) AS errors FROM l GROUP BY task_id)
SELECT *, CASE WHEN processed_files < total_files THEN 'running' WHEN errors IS NOT NULL THEN 'failed' ELSE 'completed' END AS status,
  floor(processed_files::DOUBLE / total_files * 100 + 0.5)::BIGINT AS percent FROM c""",
    "summary_cached": f"WITH {_SUMMARIES} SELECT file_path, summary FROM sums JOIN docs USING (file_path) WHERE lang = 'en'",
    "summary_missing": f"WITH {_SUMMARIES} SELECT file_path FROM docs WHERE file_path NOT IN (SELECT file_path FROM sums)",
    "summary_upsert": f"""
WITH {_SUMMARIES}, u AS (
  SELECT docs.file_path, 'new ' || source AS summary, coalesce(created_at, {_NOW}) AS created_at, {_NOW} AS updated_at FROM docs LEFT JOIN sums USING (file_path) WHERE lang = 'de'
  UNION ALL SELECT * FROM sums WHERE file_path NOT IN (SELECT file_path FROM docs WHERE lang = 'de'))
SELECT file_path, summary, {_TIMES('created_at', 'updated_at')} FROM u""",
    "document_summaries": f"""
WITH {_SUMMARIES}, n AS (SELECT file_path, CASE WHEN {_strip('text')} <> '' THEN sha256(text) ELSE '' END AS summary, {_NOW} AS created_at, {_NOW} AS updated_at FROM docs WHERE file_path NOT IN (SELECT file_path FROM sums)),
u AS (SELECT * FROM sums UNION ALL SELECT * FROM n WHERE summary <> '')
SELECT file_path, summary, {_TIMES('created_at', 'updated_at')} FROM u""",
}
