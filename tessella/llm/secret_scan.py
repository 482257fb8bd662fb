"""Secret scan over a trigram inverted index.

Each rule's regex is walked for literal strings that every match must hold; their trigrams make a Boolean query
(an AND of ORs of ANDs). The index has posting lists, by blocks of documents, of the trigrams that some query names, taken
from the lower-cased texts. A rule's query intersects and unites the lists of each block; the documents that are left are
its candidates and verified with the regex, and rules without mandatory trigrams scan every document.

Spans are code points, end exclusive, leftmost and without overlap within a kind. Defined results: a null or empty
text has none; postings go by a hash of id and text (equal hashes only add candidates), so null and repeated ids do no harm; repeated rows are scanned alike; a text
of any length is scanned whole; an empty table gives none; other columns pass through, and secrets replaces a column of
that name.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written

#: Up to so many candidates (some tens of bytes each) are broadcast to their texts; beyond, the two are joined.
BROADCAST_IDS = 500_000
#: Documents of a block of the index, about, and matches that one fold takes.
BLOCK, FOLD = 1 << 14, 256
#: (kind, regex, group, least code points of that group). The first three are the base kinds, in order.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abps]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE = ("assign", "access", "hex")
#: A literal needs no more trigrams than this in a query; they are spread over it.
PER_LITERAL = 4
_MOST = 32


def _exact(items) -> set[str] | None:
    """All strings that the items match, lower-cased, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            s = {chr(arg).lower()}
        elif op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            s = {chr(c).lower() for _, c in arg}
        elif op is C.SUBPATTERN:
            s = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(x) for x in arg[1]]
            s = None if None in parts else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[1] <= 5 and (one := _exact(arg[2])) and len(one) ** arg[1] <= _MOST:
            s, power = set(), {""}
            for n in range(arg[1] + 1):
                s |= power if n >= arg[0] else set()
                power = {a + b for a in power for b in one}
        else:
            s = None
        if not s or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _clauses(items) -> list[set[frozenset[str]]]:
    found, run = [], {""}

    def flush():
        if min(map(len, run)) >= 3:
            found.append({_trigrams(x) for x in run})

    for item in items:
        s = _exact([item])
        if s is not None and len(run) * len(s) <= _MOST and not ("" in s and min(map(len, run)) >= 3):
            run = {a + b for a in run for b in s}
            continue
        flush()
        run = s or {""}
        op, arg = item
        if s is None and op is C.SUBPATTERN:
            found += _clauses(arg[3])
        elif s is None and op is C.MAX_REPEAT and arg[0] >= 1:
            found += _clauses(arg[2])
        elif s is None and op is C.BRANCH and all(each := [_clauses(x) for x in arg[1]]):
            found.append(set().union(*(e[0] for e in each)))
    flush()
    return found


def _trigrams(text: str) -> frozenset[str]:
    every = [text[i : i + 3] for i in range(len(text) - 2)]
    step = max(1, -(-len(every) // PER_LITERAL))
    return frozenset(every[::step])


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of lower-case trigrams; empty when no trigram is mandatory."""
    out = []
    for clause in _clauses(parser.parse(pattern)):
        least = [x for x in clause if not any(y < x for y in clause)]
        out.append(sorted(sorted(x) for x in least))
    return out


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def index(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index: block, trigram and docs, its posting list: the hashes of id and text of the block's documents whose
    lower-cased text holds the trigram."""
    blocks = max(1, docs.count() // BLOCK)
    low = docs.select(_number(key, text), F.lower(F.col(f"`{text}`").cast("string")).alias("_low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda x: F.contains(F.col("_low"), x))
    each = low.select("_doc", F.explode(held).alias("trigram"))
    return each.groupBy(F.pmod("_doc", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("_doc").alias("docs"))


def _number(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")).alias("_doc")


def candidates(postings: DataFrame, queries: dict[str, list]) -> DataFrame:
    """_doc and _rules: the rules whose query the document satisfies, by intersecting and uniting each block's posting lists."""
    by = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("_lists"))  # a list for each of the rules' trigrams
    folded = lambda parts, how: parts[0] if len(parts) == 1 else f"{how}({folded(parts[:-1], how)}, {parts[-1]})"
    of = lambda t: f"coalesce(_lists[{_quote(t)}], array())"
    found = {kind: folded([folded([folded([of(t) for t in ts], "array_intersect") for ts in clause], "array_union") for clause in q], "array_intersect") for kind, q in queries.items()}
    each = by.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(x).alias("docs")) for kind, x in found.items()])).alias("f"))
    return each.select("f.kind", F.explode("f.docs").alias("_doc")).groupBy("_doc").agg(F.collect_set("kind").alias("_rules"))


def spans(text: str, number: int, pattern: str, group: int, least: int) -> Column:
    """All spans of a regex as array<struct<start, kind, end>>, from the pieces between its matches.

    A fold adds up to FOLD matches and then the folds' lengths are added up, so the cost follows the number of matches."""
    p = _quote(pattern)
    span = "array<struct<start: int, kind: int, end: int>>"
    return F.expr(f"""
        transform(transform(array(struct(regexp_extract_all({text}, {p}, 0) as m, regexp_extract_all({text}, {p}, {group}) as g, split({text}, {p}, -1) as p)), x ->
            transform(sequence(0, (size(x.m) - 1) div {FOLD}), f -> aggregate(
                transform(slice(x.m, f * {FOLD} + 1, {FOLD}), (m, i) -> struct(length(x.p[f * {FOLD} + i]) as gap, length(m) as n, length(x.g[f * {FOLD} + i]) >= {least} as ok)),
                struct(0 as at, cast(array() as {span}) as spans),
                (s, y) -> struct(s.at + y.gap + y.n as at, if(y.ok, array_append(s.spans, struct(s.at + y.gap as start, {number} as kind, s.at + y.gap + y.n as end)), s.spans) as spans)))),
            x -> flatten(zip_with(x, aggregate(x, struct(0 as at, cast(array() as array<int>) as starts), (s, y) -> struct(s.at + y.at as at, array_append(s.starts, s.at) as starts), s -> s.starts),
                (y, start) -> transform(y.spans, z -> struct(z.start + start as start, z.kind as kind, z.end + start as end)))))[0]""")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """docs with secrets: array of start, kind (its number among the rules) and end, in order."""
    queries = {k: q for k, p, _, _ in rules if (q := trigram_query(p))}
    trigrams = sorted({t for q in queries.values() for clause in q for ts in clause for t in ts})
    found = candidates(index(docs, key, text, trigrams), queries)
    found = written(found.withColumnRenamed("_doc", "_of"), "candidates")
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # then no text is shuffled
        found = F.broadcast(found)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_body"), _number(key, text))
    joined = row.join(found, F.col("_doc") == F.col("_of"), "left")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    each = []
    for i, (kind, pattern, group, least) in enumerate(rules):
        if kind in queries:
            hit = F.array_contains("_rules", kind)
        else:  # a full scan: a cheap test for one long enough match first
            hit = F.col("_body").rlike(pattern if group or not least or pattern[-1] != "+" else f"{pattern[:-1]}{{{least},}}")
        each.append(F.when(hit, spans("_body", i, pattern, group, least)).otherwise(none))
    names = [c for c in docs.columns if c.lower() != "secrets"]
    return joined.withColumn("_found", F.array_sort(F.concat(*each))).select(*[F.col(f"_row.`{c}`") for c in names], F.col("_found").alias("secrets"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.explode(F.array("secrets")).alias("secrets"))
    name = "element_at(array(" + ", ".join(f"'{r[0]}'" for r in RULES) + "), x.kind + 1)"
    text = "array_join(transform({}, x -> concat_ws(':', " + name + ", x.start, x.end)), ',')"
    count = lambda i: F.expr(f"cast(size(filter(secrets, x -> x.kind = {i})) as bigint)")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(F.expr(text.format(f"filter(secrets, x -> x.kind < {len(BASE)})")), 256).alias("base_sha256"), F.expr(text.format("secrets")).alias("spans"))


def _oracle() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {i} AS kind, '{kind}' AS name, unnest(range(1, len(m) + 1)) AS i, m, g, p, {least} AS least
  FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}'))""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), a AS ({' UNION ALL '.join(parts)}),
s AS (
  SELECT r, kind, name, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS b, length(m[i]) AS n
  FROM a WHERE length(g[i]) >= least
), j AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || b || ':' || (b + n), ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || b || ':' || (b + n), ',' ORDER BY b, kind) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)"""


OP4_SQL = _oracle()
