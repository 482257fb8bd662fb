"""Schemas of the stored tables. Stored tables are never inferred; columns that came later are back-filled as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


DOCUMENTS = _schema(
    "file_path string, file_name string, file_size long, file_hash string, modified_at timestamp, indexed_at timestamp, chunk_count long, status string, error_message string, "
    "title string, category string, tags string, difficulty string, pack_id string, chunk_strategy string, created_at timestamp, updated_at timestamp"
)
CHUNKS = _schema("file_path string, chunk_index int, section_heading string, content string, chunk_strategy string, title string, category string, tags string, difficulty string, pack_id string, embedding vector")
MESSAGES = _schema("id long, role string, content string, sources strings, created_at timestamp")
TASKS = _schema("id string, status string, total_files long, processed_files long, errors string, created_at timestamp, completed_at timestamp")
CHAT_SUMMARIES = _schema("id long, summary string, first_message_id long, last_message_id long, created_at timestamp")
SUMMARIES = _schema("file_path string, summary string, created_at timestamp, updated_at timestamp")
REVIEWS = _schema("id long, file_path string, question string, answer string, repetitions long, easiness double, interval long, due_date date, created_at timestamp, updated_at timestamp")
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "chat_messages": MESSAGES, "ingest_tasks": TASKS, "chat_summaries": CHAT_SUMMARIES, "summaries": SUMMARIES, "review_items": REVIEWS}

# Fixed values of the status and grade columns.
DOCUMENT_STATUSES = ("pending", "indexed", "error")
TASK_STATUSES = ("pending", "running", "completed", "failed")
ROLES = ("user", "assistant", "system")
GRADES = (0, 1, 2, 3, 4)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of the schema: missing ones are null, others go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """What a migration has to add."""
    have = {c.lower() for c in df.columns}
    return [f.name for f in schema if f.name.lower() not in have]


def checked(value: Column, allowed: tuple, name: str) -> Column:
    """The value; a row with another value than those allowed, or null, fails the job."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} can't be "), F.coalesce(value.cast("string"), F.lit("null")))))
