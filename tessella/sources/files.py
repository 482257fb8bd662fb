"""Files as tables: discovery, text, hashes; and paths that stay below their root."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import basename, extension
from tessella.sources.pdf import texts as pdf_texts

MARKDOWN, INGESTABLE = ("md",), ("md", "pdf")


def discover(spark: SparkSession, root: str, kinds: tuple = INGESTABLE) -> DataFrame:
    """file_path (below root), file_name, file_size, modified_at, content of the files below root, by Spark's reader.

    Suffixes are told apart by case. Bytes are only read where a query uses content.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(base)
    plain = F.regexp_replace("path", r"^[a-z]+:/{0,2}(?=/)", "")
    below = F.substr(plain, F.lit(len(_plain(base)) + 2))
    return found.select(below.alias("file_path"), basename(below).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content")


def listed(files: DataFrame) -> DataFrame:
    """The files in the order of their paths."""
    return files.orderBy("file_path")


def _plain(path: str) -> str:
    scheme, sep, rest = path.partition(":")
    return "/" + rest.lstrip("/") if sep and scheme.isalpha() else path


def read_texts(files: DataFrame, pdf: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """files with file_hash (of the raw bytes), text and error: bytes that aren't UTF-8, or a PDF that can't be read.

    pdf: another reader of PDF files than that of sources.pdf, contents to (text, error) each.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pdf(rows["content"])
            yield pd.DataFrame({"file_path": rows["file_path"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    hashed = files.withColumn("file_hash", F.sha2("content", 256))
    text = hashed.filter(extension("file_path") != ".pdf")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = text.withColumns({"text": F.when(valid, F.col("content").cast("string")), "error": F.when(~valid, "the file isn't UTF-8")}).drop("content")
    pages = hashed.filter(extension("file_path") == ".pdf")
    contents = pages.select("file_path", "content")
    told = contents.mapInPandas(run, "file_path string, text string, error string") if pdf else pdf_texts(contents)
    return text.unionByName(pages.drop("content").join(told, "file_path").select(*text.columns))


def is_ingestable(path: Column) -> Column:
    """Whether a changed path is of interest, in any case of its suffix."""
    return extension(path).isin(*[f".{k}" for k in INGESTABLE])


def is_safe(path: Column) -> Column:
    """Whether a path stays below its root: relative, and never above the root on its way."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    low = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: _down(s, x), lambda s: s["low"])
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:|\\") & (low >= 0)


def _down(s: Column, x: Column) -> Column:
    at = s["at"] + F.when(x == "..", -1).otherwise(1)
    return F.struct(at.alias("at"), F.least(s["low"], at).alias("low"))


def read_one(files: DataFrame, path: str) -> DataFrame:
    """The row of one file; an unsafe path is an error."""
    return files.filter(F.when(is_safe(F.lit(path)), F.col("file_path") == path).otherwise(F.raise_error(F.lit("the path leaves the knowledge folder")).cast("boolean")))
