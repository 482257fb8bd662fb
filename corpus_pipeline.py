"""Corpus pipeline: quality rules, line dedup, one of each near-duplicate group, source mix, pieces.

Each stage takes all that the stage before kept, and its decisions take effect: rejected documents go, repeated lines
go, of a near-duplicate group the smallest id stays, documents are repeated or dropped to their source's rate, and the
last stage adds the piece ids. All but the last return the columns of documents.

Defined results: an empty table stays empty through all stages; whole texts are processed, of any length; columns that
documents doesn't have by itself pass through every stage with their values, whatever their names, but that n_chars,
where it is there as a number, becomes that of the text as it is now, and the columns of the last stage replace their like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessella.llm.line_dedup import without_repeats
from tessella.llm.ngram_join import one_of_each
from tessella.llm.pieces import encode
from tessella.llm.quality_rules import quality_filter
from tessella.llm.shared import written
from tessella.llm.source_mix import mixed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every rule keeps; null and empty texts go, repeated rows are judged alike."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that a smaller id has; all rows stay, null texts too, and rows of one id are one document."""
    return _measured(without_repeats(docs), docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id; texts without words stay, as do all rows of that id in the
    group; a row without an id goes where its group has an id."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's rate and the hash of their id say; a null source is one, repeated rows fare alike."""
    return mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces; a null text has none."""
    return encode(docs)


def _measured(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; a numeric n_chars is that of the text as it is now."""
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("source_mix", source_mix), ("pieces", piece_ids)]
#: The pieces can't be put in SQL; tests/llm holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
