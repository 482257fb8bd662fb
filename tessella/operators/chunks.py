"""Documents to chunks: frontmatter, headings, short and long sections, fixed split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.frontmatter import frontmatter
from tessella.functions.splitter import split_each, split_rows
from tessella.functions.text import LONG_SECTION, frontmatter_body, merge_short, sections, strip

CHUNK_ARRAY = "array<struct<section_heading: string, content: string>>"


def fixed_chunks(docs: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """path, chunk_index, content by the fixed split."""
    rows = docs.select(path, F.col(text).cast("string"))
    return rows.mapInArrow(split_rows, T.StructType([rows.schema[0], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())]))


def heading_chunks(docs: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """path, chunk_index, section_heading, content: merged sections, long ones split, numbered through the document."""
    rows = docs.select(path, bare_sections(F.col(text)).alias("_bare"))
    return rows.select(path, F.posexplode(cut_sections(F.col("_bare"))).alias("chunk_index", "_c")).select(path, "chunk_index", "_c.*")


def bare_sections(text: Column) -> Column:
    """Array of (section_heading, content): the merged sections, stripped, without empty ones."""
    stripped = F.transform(merge_short(sections(text)), lambda s: F.struct(s["heading"].alias("section_heading"), strip(s["body"]).alias("content")))
    return F.filter(stripped, lambda s: s["content"] != "")


def cut_sections(bare: Column, size: int = LONG_SECTION) -> Column:
    """The sections with those longer than size split; only those go to the splitter. A document's chunks stay in its row,
    so that they need no shuffle to be numbered. bare: a column, as it is used twice."""
    cut = split_each(F.transform(bare, lambda s: F.when(F.length(s["content"]) > size, s["content"])))
    each = lambda s, c: F.transform(c, lambda x: F.struct(s["section_heading"].alias("section_heading"), x.alias("content")))
    return F.flatten(F.zip_with(bare, cut, lambda s, c: F.when(c.isNull(), F.array(s)).otherwise(each(s, c))))


def parsed(docs: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """One row a document: path, chunk_strategy, its metadata, and _chunks: array of (section_heading, content).

    Markdown is cut by headings, other text and blank bodies by the fixed split.
    """
    meta = frontmatter(F.col("_text"))
    rows = docs.select(path, F.col(text).alias("_text")).withColumns({"_meta": meta, "_body": frontmatter_body("_text")})
    markdown = F.lower(F.col(path)).endswith(".md") & (strip("_body") != "")
    plain = ~F.coalesce(markdown, F.lit(False))
    # Other text is one section of any length, so that one Python worker cuts both.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("section_heading"), F.coalesce("_body", F.lit("")).alias("content")))
    tags = F.when(F.size("_meta.tags") > 0, F.concat_ws(",", "_meta.tags"))
    # An explode keeps what is below it from being put, and computed, wherever it is used above.
    once = rows.select(path, "_meta", F.explode(F.array(F.struct(F.when(plain, whole).otherwise(bare_sections(F.when(markdown, F.col("_body")))).alias("bare"), plain.alias("plain")))).alias("_s"))
    cut = once.select(path, "_meta", F.explode(F.array(F.struct(cut_sections(F.col("_s.bare"), F.when(F.col("_s.plain"), -1).otherwise(LONG_SECTION)).alias("cut"), F.col("_s.plain").alias("plain")))).alias("_s"))
    named = cut.select(path, "_meta", F.when(~F.col("_s.plain"), F.col("_s.cut")).alias("_headed"), F.when(F.col("_s.plain"), F.col("_s.cut")).alias("_fixed"))
    # A Markdown text whose sections are all empty falls back to the fixed split, which finds nothing in it either.
    strategy = F.when(F.size("_headed") > 0, "heading-aware").otherwise("fixed-split")
    return named.select(path, strategy.alias("chunk_strategy"), F.col("_meta.title").alias("title"), F.col("_meta.category").alias("category"), tags.alias("tags"), F.col("_meta.difficulty").alias("difficulty"), F.col("_meta.pack_id").alias("pack_id"), F.when(F.size("_headed") > 0, F.col("_headed")).otherwise(F.coalesce("_fixed", F.array().cast(CHUNK_ARRAY))).alias("_chunks"))


def chunk_documents(docs: DataFrame, path: str = "file_path", text: str = "text", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks with their document's metadata, and with embed their vectors."""
    return exploded(parsed(docs, path, text), path, embed)


def exploded(rows: DataFrame, path: str = "file_path", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The chunks of parsed documents."""
    meta = ["chunk_strategy", "title", "category", "tags", "difficulty", "pack_id"]
    out = rows.select(path, *meta, F.posexplode("_chunks").alias("chunk_index", "_c")).select(path, "chunk_index", "_c.section_heading", "_c.content", *meta)
    return out.withColumn("embedding", embed(F.col("content"))) if embed else out


def chunk_counts(chunks: DataFrame, path: str = "file_path") -> DataFrame:
    return chunks.groupBy(path).agg(F.count("*").alias("chunk_count"))
