"""Text columns: stripping, counting, query routing, frontmatter, headings and numbered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a query as a comparison or as a question, in English (any case) and Chinese.
COMPARISONS = [r"\bvs\.?\b", r"\bdifference(?:s)?\s+between\b", r"\bpros?\s+and\s+cons?\b", r"\bcompare\b", r"\bcomparison\b", r"\bversus\b"]
COMPARISONS_CN = ["对比", "区别", "优缺点", "还是", "比较"]
QUESTIONS = [r"\bwhat\s+is\b", r"\bwhat\s+are\b", r"\bhow\s+does\b", r"\bhow\s+do\b", r"\bhow\s+to\b", r"\bexplain\b", r"\bdescribe\b", r"\bwhy\b", r"\bdefine\b", r"\btell\s+me\s+about\b"]
QUESTIONS_CN = ["什么是", "如何", "为什么", "怎么", "解释", "描述", "介绍"]
STRATEGIES = ["hyde", "multi_query", "none"]
# The characters that stripping takes for white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# A heading line; a frontmatter block at the start, up to the next "---" wherever it is; a numbered line.
HEADING = rf"(?md)^(#{{1,6}})[{WHITE}]+(.+)$"
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?)---[ \t]*\r?\n?"
NUMBERED = rf"^\p{{Nd}}+[.)][{WHITE}]*(.+)$"
SHORT_SECTION, LONG_SECTION = 100, 1500


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITE))


def rstrip(c) -> Column:
    return F.rtrim(_col(c), F.lit(WHITE))


def word_count(c) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def cjk_count(c) -> Column:
    return F.length(F.regexp_replace(_col(c), "[^一-鿿]", ""))


def is_cjk(c) -> Column:
    return cjk_count(c) > F.length(_col(c)) / 3


def ends_with_question(c) -> Column:
    return strip(c).endswith("?") | strip(c).endswith("？")


def is_short_query(c) -> Column:
    """Keyword-like: no final question mark, and 8 non-space characters at most (CJK) or 4 words."""
    s = strip(c)
    few = F.when(is_cjk(s), F.length(F.replace(s, F.lit(" "), F.lit(""))) <= 8).otherwise(word_count(s) <= 4)
    return (s != "") & ~ends_with_question(s) & few


def classify_strategy(c) -> Column:
    """multi_query for comparisons and short queries, hyde for questions, none else; null and blank are none."""
    s = strip(F.coalesce(_col(c), F.lit("")))
    any_of = lambda patterns, words: s.rlike("(?i)" + "|".join(patterns).replace(r"\s", f"[{WHITE}]")) | s.rlike("|".join(words))
    return (
        F.when(s == "", "none")
        .when(any_of(COMPARISONS, COMPARISONS_CN) | is_short_query(s), "multi_query")
        .when(any_of(QUESTIONS, QUESTIONS_CN), "hyde")
        .when(ends_with_question(s) & (is_cjk(s) | (word_count(s) >= 5)), "hyde")
        .otherwise("none")
    )


def checked_strategy(answer, question) -> Column:
    """A model's answer if it names a strategy, else the rules' choice."""
    a = F.lower(strip(F.coalesce(_col(answer), F.lit(""))))
    return F.when(a.isin(STRATEGIES), a).otherwise(classify_strategy(question))


def role_label(c) -> Column:
    r = _col(c)
    return F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))


def transcript_line(role, content) -> Column:
    return F.concat(role_label(role), F.lit(": "), _col(content))


def numbered_lines(c) -> Column:
    """The texts of lines like "1. text" or "2) text", in order."""
    lines = F.transform(F.split(_col(c), "\n"), strip)
    return F.transform(F.filter(lines, lambda x: x.rlike(NUMBERED)), lambda x: strip(F.regexp_extract(x, NUMBERED, 1)))


def with_original(variants, question) -> Column:
    """The variants, the question before them unless it is among them."""
    v, q = _col(variants), _col(question)
    return F.when(F.array_contains(v, q), v).otherwise(F.concat(F.array(q), v))


def frontmatter_block(c) -> Column:
    return F.nullif(F.regexp_extract(_col(c), FRONTMATTER, 0), F.lit(""))


def frontmatter_yaml(c) -> Column:
    return F.when(frontmatter_block(c).isNotNull(), F.regexp_extract(_col(c), FRONTMATTER, 1))


def frontmatter_body(c) -> Column:
    t = _col(c)
    return F.substr(t, F.length(F.regexp_extract(t, FRONTMATTER, 0)) + 1)


def sections(c) -> Column:
    """Array of (heading, body): the text before the first heading, if not blank, and each heading's text."""
    t = _col(c)
    parts, heads = F.split(t, HEADING, -1), F.regexp_extract_all(t, F.lit(HEADING), F.lit(2))
    pair = lambda h, b: F.struct(h.alias("heading"), b.alias("body"))
    after = F.zip_with(heads, F.slice(parts, F.lit(2), F.size(parts)), lambda h, b: pair(strip(h), b))
    before = F.element_at(parts, 1)
    return F.when(F.size(heads) == 0, F.array(pair(F.lit(""), t))).when(strip(before) == "", after).otherwise(F.concat(F.array(pair(F.lit(""), before)), after))


def merge_short(c) -> Column:
    """Sections shorter than SHORT_SECTION join the next one, under the first heading; a last one joins the one before."""
    part = "struct<heading: string, body: string>"
    empty = F.struct(F.expr(f"cast(array() as array<{part}>)").alias("done"), F.lit("").alias("heading"), F.lit("").alias("body"))
    # What waits is short, so only short texts are joined and stripped again.
    bare = F.transform(_col(c), lambda x: F.struct(x["heading"].alias("heading"), x["body"].alias("body"), strip(x["body"]).alias("bare")))

    def step(s: Column, x: Column) -> Column:
        waiting = s["body"] != ""
        joined = F.concat(rstrip(s["body"]), F.lit("\n\n"), x["bare"])
        head = F.when(waiting, s["heading"]).otherwise(x["heading"])
        short = F.when(F.length(x["bare"]) >= SHORT_SECTION, False).otherwise(F.when(waiting, F.length(strip(joined))).otherwise(F.length(x["bare"])) < SHORT_SECTION)
        one = F.struct(head.alias("heading"), F.when(waiting, joined).otherwise(x["body"]).alias("body"))
        return F.when(short, F.struct(s["done"].alias("done"), head.alias("heading"), F.when(waiting, joined).otherwise(x["bare"]).alias("body"))).otherwise(
            F.struct(F.array_append(s["done"], one).alias("done"), F.lit("").alias("heading"), F.lit("").alias("body"))
        )

    def finish(s: Column) -> Column:
        last = F.element_at(s["done"], -1)
        longer = F.struct(last["heading"].alias("heading"), F.concat(rstrip(last["body"]), F.lit("\n\n"), s["body"]).alias("body"))
        alone = F.array(F.struct(s["heading"].alias("heading"), s["body"].alias("body")))
        return F.when(s["body"] == "", s["done"]).when(F.size(s["done"]) == 0, alone).otherwise(F.array_append(F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1), longer))

    return F.aggregate(bare, empty, step, finish)


def basename(c) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def parent(c) -> Column:
    return F.regexp_replace(_col(c), r"/?[^/]*$", "")


def extension(c) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"(\.[^./]+)$", 1))
