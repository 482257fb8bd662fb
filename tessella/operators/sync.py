"""Keeping the tables in step with the files: snapshot diff, and table changes as functions of old tables and changes.

Parquet tables have no MERGE, so each change is old DataFrame x changes -> new DataFrame, a single equi-join on
file_path. sync_stored() applies them to the buckets that the changed files are in, and to no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import models
from tessella.operators.chunks import exploded, parsed
from tessella.schemas import CHUNKS, DOCUMENTS, conform
from tessella.sources import buckets, workspace
from tessella.sources.files import is_safe

CHANGES = ("new", "modified", "unchanged", "deleted")
_META = ("title", "category", "tags", "difficulty", "pack_id", "chunk_strategy")


def snapshot_diff(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """file_path, disk_hash, stored_hash, change. A null stored hash (a failed file) differs from any hash, so it is retried."""
    d = disk.select("file_path", F.col("file_hash").alias("disk_hash"), F.lit(True).alias("_d"))
    s = stored.select("file_path", F.col("file_hash").alias("stored_hash"), F.lit(True).alias("_s"))
    change = F.when(F.col("_s").isNull(), "new").when(F.col("_d").isNull(), "deleted").when(F.col("disk_hash").eqNullSafe(F.col("stored_hash")), "unchanged").otherwise("modified")
    return d.join(s, "file_path", "full_outer").select("file_path", "disk_hash", "stored_hash", change.alias("change"))


def sync_counters(diff: DataFrame) -> DataFrame:
    """One row: how many files are new, modified and deleted."""
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "modified", "deleted")])


def to_ingest(diff: DataFrame, force: bool = False) -> DataFrame:
    """The files to read: new and modified ones; with force, unchanged ones too."""
    return diff.filter(F.col("change").isin("new", "modified", *(["unchanged"] if force else [])))


def ingest_status(change: Column, force: bool = False) -> Column:
    """What becomes of a file: skipped when unchanged, unless forced."""
    return F.when((change == "unchanged") & F.lit(not force), "skipped").otherwise("indexed")


def upsert_documents(stored: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """stored with the ingested files in it: an update keeps created_at and clears the error.

    done: file_path, file_name, file_size, file_hash, modified_at, chunk_count and the metadata columns.
    """
    new = done.select("file_path", F.struct(*[F.col(c) for c in done.columns if c != "file_path"]).alias("_new"))
    both = stored.join(new, "file_path", "full_outer")
    changed = F.col("_new").isNotNull()
    set_to = {c: F.col(f"_new.{c}") for c in done.columns if c != "file_path"}
    set_to |= {"status": F.lit("indexed"), "error_message": F.lit(None).cast("string"), "indexed_at": now, "updated_at": now, "created_at": F.coalesce(F.col("created_at"), now)}
    return both.select(*[F.when(changed, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in stored.columns])


def upsert_errors(stored: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """stored with the failed files (file_path, file_name, error_message): known ones keep their hash and chunk count."""
    bad = failed.select("file_path", F.col("file_name").alias("_name"), F.col("error_message").alias("_error"), F.lit(True).alias("_bad"))
    both = stored.join(bad, "file_path", "full_outer")
    set_to = {
        "file_name": F.coalesce("file_name", "_name"), "status": F.lit("error"), "error_message": F.col("_error"), "updated_at": now,
        "created_at": F.coalesce("created_at", now), "chunk_count": F.coalesce("chunk_count", F.lit(0)), "modified_at": F.coalesce("modified_at", now),
    }
    return both.select(*[F.when(F.col("_bad"), set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in stored.columns])


def delete_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks or documents without those of the files that are gone."""
    return table.join(gone.select("file_path").distinct(), "file_path", "left_anti")


def rename_conflicts(documents: DataFrame, renames: DataFrame) -> DataFrame:
    """The renames (file_path, new_path) that can't be made: the target exists, or two files would get it."""
    taken = renames.join(documents.select(F.col("file_path").alias("new_path")), "new_path", "left_semi")
    twice = renames.join(renames.groupBy("new_path").agg(F.count("*").alias("_n")).filter("_n > 1"), "new_path", "left_semi")
    return taken.unionByName(twice).select("file_path", "new_path").distinct()


def rename_files(table: DataFrame, renames: DataFrame) -> DataFrame:
    """Chunks or documents with the renamed files under their new path (and file name)."""
    both = table.join(renames.select("file_path", F.col("new_path").alias("_to")), "file_path", "left")
    path = F.coalesce("_to", "file_path")
    name = {"file_path": path, "file_name": F.when(F.col("_to").isNull(), F.col("file_name")).otherwise(F.element_at(F.split("_to", "/"), -1))} if "file_name" in table.columns else {"file_path": path}
    return both.select(*[name[c].alias(c) if c in name else F.col(c) for c in table.columns])


def rename(documents: DataFrame, chunks: DataFrame, renames: DataFrame) -> dict[str, DataFrame]:
    """Documents and chunks after the renames that can be made, and the refused ones (see rename_conflicts)."""
    refused = rename_conflicts(documents, renames)
    made = renames.join(refused, ["file_path", "new_path"], "left_anti")
    return {"documents": rename_files(documents, made), "chunks": rename_files(chunks, made), "refused": refused}


def replace_chunks(chunks: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """chunks with those of the touched files replaced by fresh ones; a file without fresh chunks has none."""
    return delete_files(chunks, touched).unionByName(fresh, allowMissingColumns=True)


def to_migrate(documents: DataFrame) -> DataFrame:
    """Indexed documents from before chunk strategies were kept; they are ingested again with force."""
    return documents.filter(F.col("chunk_strategy").isNull() & (F.col("status") == "indexed"))


def metadata(meta: Column) -> Column:
    """A frontmatter struct with its tags as comma-separated text, null when there are none."""
    tags = F.when(F.size(meta["tags"]) > 0, F.concat_ws(",", meta["tags"]))
    return F.struct(*[(tags if f == "tags" else meta[f]).alias(f) for f in ("title", "category", "tags", "difficulty", "pack_id")])


def once(df: DataFrame) -> DataFrame:
    """df kept in the checkpoint folder, so that what is derived from it twice is computed once; df itself where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def sync(disk: DataFrame, documents: DataFrame, chunks: DataFrame, now: Column, force: bool = False, embed: Callable[[Column], Column] | None = models.embed) -> dict[str, DataFrame]:
    """One pass: diff, then documents and chunks as they are afterwards, and the counters. Fresh chunks get their vectors.

    disk: file_path, file_name, file_size, file_hash, modified_at, text, error (null where the text could be read). A
    document's metadata are those of its frontmatter, whether or not it has chunks.
    """
    diff = snapshot_diff(disk, documents)
    wanted = disk.join(to_ingest(diff, force), "file_path", "left_semi")
    good, bad = wanted.filter("error is null"), wanted.filter("error is not null")
    rows = once(parsed(good))
    fresh = exploded(rows, embed=embed)
    about = rows.select("file_path", *_META, F.size("_chunks").cast("long").alias("chunk_count"))
    done = good.select("file_path", "file_name", "file_size", "file_hash", "modified_at").join(about, "file_path")
    gone = diff.filter("change = 'deleted'")
    docs = upsert_errors(upsert_documents(delete_files(documents, gone), done, now), bad.select("file_path", "file_name", F.col("error").alias("error_message")), now)
    touched = gone.select("file_path").unionByName(good.select("file_path"))
    return {"diff": diff, "documents": docs, "chunks": replace_chunks(chunks, fresh, touched), "counters": sync_counters(diff)}


def sync_stored(disk: DataFrame, documents: str, chunks: str, now: Column, force: bool = False, embed: Callable[[Column], Column] | None = models.embed) -> dict[str, int]:
    """sync() of tables stored in buckets (their paths): only the buckets of changed files are written. Gives the counters.

    Chunks are changed first: a pass that is lost between the two finds its files changed again.
    """
    spark = disk.sparkSession
    stored = buckets.read(spark, documents)
    diff = workspace.written(snapshot_diff(disk, stored), "diff")
    touched = diff.filter(F.lit(force) | (F.col("change") != "unchanged")).select("file_path")
    of = lambda df: df.join(touched, "file_path", "left_semi")
    rest = lambda df: df.join(touched, "file_path", "left_anti")
    buckets.change(spark, chunks, touched, lambda old: rest(old).unionByName(conform(sync(of(disk), of(stored), of(old), now, force, embed)["chunks"], CHUNKS)))
    buckets.change(spark, documents, touched, lambda old: rest(old).unionByName(conform(sync(of(disk), of(old), spark.createDataFrame([], CHUNKS), now, force, None)["documents"], DOCUMENTS)))
    return sync_counters(diff).first().asDict()


def reembed(chunks: DataFrame, embed: Callable[[Column], Column] = models.embed) -> DataFrame:
    """All chunks with vectors by another embedder; nothing else of them changes."""
    return chunks.withColumn("embedding", embed(F.col("content")))


def migrate(disk: DataFrame, documents: DataFrame, chunks: DataFrame, now: Column, embed: Callable[[Column], Column] | None = models.embed) -> dict[str, DataFrame]:
    """Documents, chunks and counters after the documents to migrate were ingested again, changed or not.

    Those whose file is gone or can't be read become errors, as in any ingest; all others stay as they are.
    """
    old = to_migrate(documents)
    missing = old.join(disk, "file_path", "left_anti").select("file_path", "file_name", F.lit("the file is gone").alias("error_message"))
    again = sync(disk.join(old, "file_path", "left_semi"), documents.join(old, "file_path", "left_semi").join(missing, "file_path", "left_anti"), chunks, now, True, embed)
    docs = again["documents"].unionByName(upsert_errors(documents.join(missing, "file_path", "left_semi"), missing, now)).unionByName(documents.join(old, "file_path", "left_anti"))
    counters = old.agg(F.count("*").alias("total")).crossJoin(F.broadcast(docs.join(old, "file_path", "left_semi").agg(F.count_if(F.col("status") == "error").alias("failed"))))  # two single rows
    return {"documents": docs, "chunks": again["chunks"], "counters": counters}


def saved(disk: DataFrame, path: str, text: str, now: Column) -> DataFrame:
    """disk with a file's text saved, a new file or a known one: sync() then ingests it."""
    row = disk.sparkSession.range(1).select(F.when(is_safe(F.lit(path)), path).otherwise(F.raise_error(F.lit("the path leaves the knowledge folder")).cast("string")).alias("file_path"), F.lit(text).alias("text"))
    new = row.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("file_hash"), now.alias("modified_at"), "text", F.lit(None).cast("string").alias("error"))
    return disk.filter(F.col("file_path") != path).unionByName(new, allowMissingColumns=True)
