"""Snapshot diff that passes over folders in which nothing has changed.

A folder's hash is that of all files below it: the sum, in four numbers, of a hash of each file's path and content hash, so
it is the sum of its children's and takes one aggregation that combines before the shuffle, however many files a folder
has. Where the hashes of a folder agree in both snapshots so does everything below it, and only files right inside other
folders meet in a join. The folders of a stored snapshot may be kept as a table beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import parent
from tessella.operators.sync import snapshot_diff

_PARTS = 4


def _numbers() -> list[Column]:
    told = F.sha2(F.concat_ws("\n", F.octet_length("file_path").cast("string"), "file_path", F.coalesce(F.concat(F.lit("="), "file_hash"), F.lit("-"))), 256)
    return [F.conv(F.substring(told, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"_{i}") for i in range(_PARTS)]


def ancestors(path: Column) -> Column:
    """The folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def folder_hashes(files: DataFrame) -> DataFrame:
    """folder, n_files (at any depth) and hash of every folder of files (file_path, file_hash), the root included."""
    each = files.select(F.explode(ancestors(F.col("file_path"))).alias("folder"), *_numbers())
    sums = each.groupBy("folder").agg(F.count("*").alias("n_files"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(_PARTS)])
    return sums.select("folder", "n_files", F.sha2(F.concat_ws(":", F.col("n_files").cast("string"), *[F.col(f"_{i}").cast("string") for i in range(_PARTS)]), 256).alias("hash"))


def unchanged_folders(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """folder of those whose hashes agree. disk, stored: of folder_hashes()."""
    return disk.join(stored.select("folder", "hash"), ["folder", "hash"]).select("folder")


def diff_by_folder(disk: DataFrame, stored: DataFrame, stored_folders: DataFrame | None = None) -> DataFrame:
    """The rows of snapshot_diff(); files in folders that agree are unchanged without a comparison."""
    same = unchanged_folders(folder_hashes(disk), stored_folders if stored_folders is not None else folder_hashes(stored)).withColumnRenamed("folder", "_folder")
    placed = lambda df: df.withColumn("_folder", parent("file_path"))
    open_ = lambda df: placed(df).join(same, "_folder", "left_anti").drop("_folder")
    closed = placed(disk).join(same, "_folder", "left_semi")
    kept = closed.select("file_path", F.col("file_hash").alias("disk_hash"), F.col("file_hash").alias("stored_hash"), F.lit("unchanged").alias("change"))
    return snapshot_diff(open_(disk), open_(stored)).unionByName(kept)


def compared(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: n_files on disk, and n_compared of them."""
    same = unchanged_folders(folder_hashes(disk), folder_hashes(stored)).select(F.col("folder").alias("_folder"), F.lit(True).alias("_same"))
    return disk.withColumn("_folder", parent("file_path")).join(same, "_folder", "left").agg(F.count("*").alias("n_files"), F.count_if(F.col("_same").isNull()).alias("n_compared"))
