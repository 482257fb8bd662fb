"""DuckDB SQL of the queries that cut texts into chunks: the overlap split as relations.

A text is cut at the first separator that it has; pieces of a chunk's length or more are texts of the next level. The
others of a stretch are packed from prefix sums of their lengths: a window of pieces grows until the next would be too
much, is a chunk, and then starts at the first piece that leaves few enough characters for the overlap.
"""

from __future__ import annotations

from tessella.functions.splitter import OVERLAP, SEPARATORS, SIZE
from tessella.plans.retrieval import _BM25
from tessella.plans.tables_sql import _DOCS, _FRONT, _MD, _NL, _STORED, ORACLES, _strip

_LAST = len(SEPARATORS) - 1
_SEPARATORS = "[" + ", ".join("'" + "' || chr(10) || '".join(s.split("\n")) + "'" for s in SEPARATORS) + "]"
_LEVEL = "list_position(list_transform(range(1, {n} + 1), lambda i: i > level AND contains(text, sep[i])), true)".format(n=len(SEPARATORS))


def split(source: str) -> str:
    """CTEs that end with cut: id, no (from 0) and content of the chunks of source (id, text). They need WITH RECURSIVE."""
    return f"""
sep AS (SELECT {_SEPARATORS} AS sep),
seg AS (
  SELECT id, []::BIGINT[] AS way, text, 0::BIGINT AS level FROM {source}
  UNION ALL
  SELECT id, list_append(way, no), piece, cut_at FROM (
    SELECT id, way, cut_at, unnest(range(len(p))) AS no, unnest(p) AS piece FROM (
      SELECT id, way, cut_at, list_transform(string_split(text, sep[cut_at]), lambda x, i: CASE WHEN i = 1 THEN x ELSE sep[cut_at] || x END) AS p FROM (SELECT *, {_LEVEL} AS cut_at FROM seg, sep) WHERE cut_at <= {_LAST}))
  WHERE length(piece) >= {SIZE}),
pieces AS (
  SELECT id, way, cut_at, unnest(range(len(p))) AS no, unnest(p) AS piece FROM (
    SELECT id, way, cut_at, list_transform(string_split(text, sep[cut_at]), lambda x, i: CASE WHEN i = 1 THEN x ELSE sep[cut_at] || x END) AS p FROM (SELECT *, {_LEVEL} AS cut_at FROM seg, sep))),
small AS (
  SELECT * FROM (SELECT *, length(piece) >= {SIZE} AND cut_at <= {_LAST} AS big, count(*) FILTER (length(piece) >= {SIZE} AND cut_at <= {_LAST}) OVER (PARTITION BY id, way ORDER BY no) AS stretch FROM pieces WHERE piece <> '') WHERE NOT big),
packs AS (
  SELECT id, list_append(way, min(no)) AS way, list(piece ORDER BY no) AS p, list_prepend(0::BIGINT, list(total::BIGINT ORDER BY no)) AS c
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY id, way, stretch ORDER BY no) AS total FROM small) GROUP BY id, way, stretch),
win AS (
  SELECT id, way, p, list_reduce(list_transform(range(1, len(p) + 1), lambda i: {{'a': 1::BIGINT, 'i': i, 'out': []::STRUCT(a BIGINT, b BIGINT)[]}}), lambda s, x:
    CASE WHEN s.a < x.i AND c[x.i + 1] - c[s.a] > {SIZE} THEN {{
      'a': s.a - 1 + list_position(list_transform(range(s.a, x.i + 1), lambda k: c[x.i] - c[k] <= {OVERLAP} AND (c[x.i] = c[k] OR c[x.i + 1] - c[k] <= {SIZE})), true),
      'i': x.i, 'out': list_append(s.out, {{'a': s.a, 'b': x.i - 1}})}}
    ELSE {{'a': s.a, 'i': x.i, 'out': s.out}} END) AS s FROM packs),
told AS (SELECT id, way, unnest(range(len(s.out) + 1)) AS n, unnest(list_append(s.out, {{'a': s.a, 'b': len(p)}})) AS w, p FROM win),
chunk AS (SELECT id, way, n, {_strip("array_to_string(p[w.a:w.b], '')")} AS content FROM told),
cut AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY way, n) - 1 AS no, content FROM chunk WHERE content <> '')"""


_MERGED = ORACLES["sections_merged"]
# The CTEs of the merged sections, of texts with these ids and texts.
_SECTIONS = lambda text: _MERGED[_MERGED.index("k AS (") : _MERGED.rindex("SELECT doc_id, no::INTEGER")].replace("FROM md)", f"FROM {text})", 1)
_BARE = f"""z AS (SELECT doc_id, no, heading, {_strip("body")} AS content FROM ({_MERGED[_MERGED.rindex("SELECT doc_id, no::INTEGER") :]})),
lengthy AS (SELECT doc_id || ':' || no AS id, content AS text FROM z WHERE length(content) > 1500)"""
_HEADED = f"""headed AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY z.no, cut.no) - 1 AS no, heading, coalesce(cut.content, z.content) AS content FROM z LEFT JOIN cut ON cut.id = doc_id || ':' || z.no
  WHERE z.content <> '' AND (length(z.content) <= 1500 OR cut.content IS NOT NULL))"""

_FIXED = f"WITH RECURSIVE {_DOCS}, src AS (SELECT file_path AS id, text FROM docs), {split('src')}"

_SYNCED = f"""
WITH RECURSIVE {_STORED}, t AS (SELECT doc_id, file_path, text FROM docs JOIN diff USING (file_path) WHERE change IN ('new', 'modified')),
body AS (SELECT doc_id, substr(text, 1 + length(regexp_extract(text, {_FRONT}, 0))) AS text FROM t), {_SECTIONS("body")}, {_BARE}, {split("lengthy")}, {_HEADED}"""

_RANKED = _BM25.replace("doc_id AS key", "key").replace("coalesce(text, '')", "content", 1).replace("FROM documents", "FROM keyed")

CHUNK_ORACLES = {
    "bm25_prompts": f"""{_FIXED}, keyed AS (SELECT id || '#' || no AS key, id AS file_path, content FROM cut), {_RANKED},
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5),
x AS (SELECT query_id, string_agg('[Source: ' || file_path || ']' || {_NL} || content, {_NL} || {_NL} ORDER BY rank) AS context FROM h JOIN keyed USING (key) GROUP BY query_id)
SELECT item_id AS query_id, coalesce('Context from knowledge base:' || {_NL} || {_NL} || context, 'No relevant context was found in the knowledge base.') || {_NL} || {_NL} || 'Question: ' || text AS "user"
FROM benchmark LEFT JOIN x ON item_id = query_id""",
    "sync_text_chunks": f"""{_SYNCED}
SELECT 'doc/' || doc_id || '.md' AS file_path, no AS chunk_index, heading AS section_heading, content, 'heading-aware' AS chunk_strategy FROM headed
UNION ALL SELECT file_path, 0, NULL, 'old ' || file_path, NULL FROM diff WHERE change = 'unchanged'""",
    "sync_text_documents": f"""{_SYNCED}
SELECT file_path, sha256(text) AS file_hash, coalesce(n, 0) AS chunk_count, CASE WHEN n > 0 THEN 'heading-aware' ELSE 'fixed-split' END AS chunk_strategy, 'indexed' AS status, '2024-02-01 00:00:00' AS indexed_at
FROM t LEFT JOIN (SELECT doc_id, count(*) AS n FROM headed GROUP BY doc_id) USING (doc_id)
UNION ALL SELECT file_path, file_hash, chunk_count, chunk_strategy, status, strftime(indexed_at, '%Y-%m-%d %H:%M:%S') FROM stored JOIN diff USING (file_path) WHERE change = 'unchanged'""",
    "chunks_fixed": f"{_FIXED} SELECT id AS file_path, no::INTEGER AS chunk_index, content FROM cut",
    "chunk_counts": f"{_FIXED} SELECT id AS file_path, count(*) AS chunk_count FROM cut GROUP BY id",
    "chunks_by_heading": f"""
WITH RECURSIVE {_MD}, {_SECTIONS("md")}, {_BARE}, {split("lengthy")}, {_HEADED}
SELECT 'doc/' || doc_id || '.md' AS file_path, no::INTEGER AS chunk_index, heading AS section_heading, content FROM headed""",
    "chunks_with_metadata": f"""
WITH RECURSIVE {_MD}, body AS (SELECT doc_id, substr(text, 1 + length(regexp_extract(text, {_FRONT}, 0))) AS text FROM md), {_SECTIONS("body")}, {_BARE}, {split("lengthy")}, {_HEADED}
SELECT 'doc/' || doc_id || '.md' AS file_path, no::INTEGER AS chunk_index, heading AS section_heading, content, 'heading-aware' AS chunk_strategy, CASE WHEN lang <> 'en' THEN 'Of ' || source END AS title,
  CASE WHEN lang <> 'en' THEN lang END AS category, CASE WHEN lang <> 'en' THEN 'a,b' END AS tags, NULL::VARCHAR AS difficulty, CASE WHEN lang <> 'en' THEN 'p1' END AS pack_id
FROM headed JOIN documents USING (doc_id)""",
}
