"""Quality rules: a threshold table compiled into one Spark projection.

All metrics are built-in column expressions, so a document is judged in one scan without a shuffle.

Defined results: a null or empty text has no words and fails; a null threshold metric (a ratio without a
denominator) passes its rule; repeated rows are judged alike, ids play no part; a text of any length is judged whole,
its words compared as words and not as hashes; an empty table gives none; other columns pass through untouched, and a
clashing name is replaced by the metric, but not by quality_filter(), which only drops rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was with on as are by be this or from at le la les de des et du que en est un une dans "
    "pour par sur au qui il der die das und den von zu mit im ein eine ist nicht auf für el los las y por con una se del"
).split()

#: (rule, metric expression, lowest, highest); None leaves a side open.
THRESHOLDS = (
    ("words", "n_words", 50, None),
    ("repeats", "100.0 * n_repeat_words / n_words", None, 50),
    ("mean_word_chars", "word_chars / n_words", 2, 15),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.6),
    ("stop_words", "n_stop_words", 1, None),
)


def rule(metric: str, lowest, highest) -> Column:
    """The rule as a column: true where it passes or its metric is null."""
    value, ok = F.expr(f"try_divide({metric.replace(' / ', ', ')})" if " / " in metric else metric), F.lit(True)
    if lowest is not None:
        ok = ok & (value >= F.lit(lowest))
    if highest is not None:
        ok = ok & (value <= F.lit(highest))
    return F.coalesce(ok, F.lit(True))


def repeat_words() -> Column:
    """Words covered by three-word windows that occur twice or more, from the array _same of the windows that do.

    The covered words follow from the gaps between the repeated windows' indexes.
    """
    return F.expr("""
        aggregate(
            array_sort(transform(filter(
                transform(_same, (x, i) -> if(
                    (i > 0 and x.w <=> _same[greatest(i - 1, 0)].w) or (i < size(_same) - 1 and x.w <=> _same[least(i + 1, size(_same) - 1)].w), x.i, -1L)),
                x -> x >= 0), x -> x)),
            struct(0L as total, -3L as last),
            (s, x) -> struct(s.total + least(3L, x - s.last) as total, x as last),
            s -> s.total)""")


#: Windows whose hash may repeat, by index. Each window is one long, the high bits of its hash over its index, so that
#: equal windows are neighbours in one primitive sort.
_LIKELY = """
    filter(transform(_sorted, (x, i) -> if(
        (i > 0 and shiftright(x, _bits) = shiftright(_sorted[greatest(i - 1, 0)], _bits))
        or (i < n_words - 3 and shiftright(x, _bits) = shiftright(_sorted[least(i + 1, cast(n_words - 3 as int))], _bits)),
        x & (shiftleft(1L, _bits) - 1), -1L)), x -> x >= 0 and n_words >= 4)"""
#: These with their words, sorted: here equal windows are neighbours whatever their hashes.
_EXACT = f"sort_array(transform({_LIKELY}, i -> struct(slice(_words, cast(i as int) + 1, 3) as w, i as i)))"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with METRICS, n_lines and n_stop_words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    kept = [c for c in docs.columns if c.lower() not in {*METRICS, "n_lines", "n_stop_words"}]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"), (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.array_intersect("_words", stop)).cast("long"),
        "_bits": F.expr("cast(ceil(log2(greatest(size(_words), 2))) as int)"),
    })
    window = "sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & ~(shiftleft(1L, _bits) - 1)) | i))"
    out = out.withColumn("_sorted", F.expr(f"if(n_words < 4, array(0L), {window})"))
    out = out.withColumn("_same", F.expr(_EXACT)).withColumn("n_repeat_words", repeat_words())
    # Generate keeps a filter on the metrics above them; pushed below, it would compute the arrays anew for each element.
    metrics = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    return out.select("_row", F.explode(F.array(metrics)).alias("_metrics")).select(*[F.col(f"_row.`{c}`") for c in kept], "_metrics.*")


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """measure(), with base_failed (the first two rules of the contract), failed_rules and kept."""
    failed = F.filter(F.array(*[F.when(~rule(*t[1:]), F.lit(t[0])) for t in thresholds]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, text).withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_filter(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that every rule keeps, with their own columns only."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    return judge(row, "_text", thresholds).filter("kept").select("_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *METRICS, "base_failed", "kept")


_WS = r"[^\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WS}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS l FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g
), n AS (
  SELECT r, count(DISTINCT i + k) AS n FROM h, range(3) AS o(k) WHERE c > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l) AS n_lines, len(list_intersect(w, [{_STOP}])) AS n_stop
  FROM d LEFT JOIN n USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
    AND n_symbols <= 0.25 * n_words AND n_dup_lines <= 0.6 * n_lines AND n_stop >= 1 AS kept
FROM m"""
