"""Tables out: versions of stored tables, chat history, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.memory import export_rows, ordered_text
from tessella.schemas import TABLES, conform
from tessella.sources.files import is_safe
from tessella.sources.zipped import one_archive

#: Bytes of files that go to one archive.
ARCHIVE_BYTES = 64 << 20
#: Message ids in a file of an exported chat.
CHAT_LINES = 10_000


def write_table(df: DataFrame, name: str, path: str, **options) -> None:
    """One of the stored tables, in its schema, as a new version of a folder."""
    conform(df, TABLES[name]).write.options(**options).parquet(path)


def append_messages(messages: DataFrame, path: str) -> None:
    conform(messages, TABLES["chat_messages"]).write.mode("append").parquet(path)


def write_chat(messages: DataFrame, path: str) -> None:
    """The history as lines of JSON in the order of time: files sort as their rows do."""
    export_rows(messages).write.json(path)


def archives(files: DataFrame) -> DataFrame:
    """part, n_files, archive: deflated ZIP archives of the files (file_path, content), each of about ARCHIVE_BYTES.

    Files are dealt to archives by a hash, so none is built on the driver and all grow alike; unsafe paths are errors.
    """
    total = files.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // ARCHIVE_BYTES))
    ok = F.when(is_safe(F.col("file_path")), F.col("file_path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path "), F.col("file_path"))).cast("string"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in pdf.sort_values("file_path").itertuples():
                z.writestr(zipfile.ZipInfo(row.file_path, (1980, 1, 1, 0, 0, 0)), bytes(row.content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n_files": [len(pdf)], "archive": [out.getvalue()]})

    dealt = files.select(ok.alias("file_path"), F.col("content").cast("binary").alias("content"), F.pmod(F.xxhash64("file_path"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(build, "part int, n_files long, archive binary")


def unpacked(packed: DataFrame) -> DataFrame:
    """file_path, content of the files in archives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["archive"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"file_path": [name], "content": [z.read(name)]})

    return packed.select("archive").mapInPandas(run, "file_path string, content binary")


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation report, a row, as a line of JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def highest_id(spark: SparkSession, path: str) -> int | None:
    """The highest id that is stored there; None where nothing is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(TABLES["chat_messages"]).parquet(path).agg(F.max("id")).first()[0]


def write_answers(answers: DataFrame, path: str, now: Column) -> None:
    """Answers (query_id, question, answer, sources, error) as two messages each; one that failed keeps what was said before.

    Ids rise with query_id and turn, and from what is stored: they are moved up where they would not lie above it.
    """
    turns = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("array<string>").alias("sources")),
        F.struct(F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("content"), F.col("sources").alias("sources")),
    )
    each = answers.select("query_id", F.posexplode(turns).alias("turn", "m")).filter("turn = 0 or m.content <> ''")
    have, least = highest_id(answers.sparkSession, path), answers.agg(F.min("query_id")).first()[0]
    up = max(0, have + 1 - 2 * least) if have is not None and least is not None else 0
    append_messages(each.select((F.col("query_id") * 2 + F.col("turn") + up).alias("id"), "m.*", now.alias("created_at")), path)


def export_members(files: DataFrame, messages: DataFrame, settings: str) -> DataFrame:
    """file_path and content of an export: the files below knowledge/, of the settings, and of the chat: files of JSON lines of CHAT_LINES ids each, named so that they sort by id."""
    line = F.to_json(F.struct("role", "content", "sources", "created_at"))
    part = F.concat(F.lit("chat/"), F.lpad(F.floor(F.col("id") / CHAT_LINES).cast("string"), 12, "0"), F.lit(".jsonl"))
    chat = messages.groupBy(part.alias("file_path")).agg(ordered_text("id", line).cast("binary").alias("content"))
    config = files.sparkSession.range(1).select(F.lit("config.yaml").alias("file_path"), F.lit(settings).cast("binary").alias("content"))
    below = files.select(F.concat(F.lit("knowledge/"), "file_path").alias("file_path"), F.col("content").cast("binary").alias("content"))
    return below.unionByName(config).unionByName(chat)


def full_export(files: DataFrame, messages: DataFrame, settings: str) -> DataFrame:
    """Archives of an export, each of about ARCHIVE_BYTES."""
    return archives(export_members(files, messages, settings))


def whole_export(files: DataFrame, messages: DataFrame, settings: str) -> DataFrame:
    """One archive of an export, as pieces in order (section, place, piece): see zipped.one_archive()."""
    return one_archive(export_members(files, messages, settings))
