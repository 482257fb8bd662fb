"""Evaluation sets and pack manifests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("question", "ground_truth")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth from a JSON array or from lines of JSON; a row without one of them is an error."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    array = head is not None and head.value.lstrip().startswith("[")
    rows = spark.read.schema("question string, ground_truth string, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", array).json(path)
    bad = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("question").isNull() | F.col("ground_truth").isNull(), "a required field is missing")
    return rows.withColumn("_ok", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("bad row: "), bad)).cast("boolean")).otherwise(True)).filter("_ok").select(*REQUIRED)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """pack_id, name, description, author, tags, file_count, size_kb, path of a manifest file."""
    pack = "array<struct<id: string, name: string, description: string, author: string, tags: array<string>, file_count: bigint, size_kb: bigint, path: string>>"
    rows = spark.read.schema(f"version string, packs {pack}").option("multiLine", True).json(path)
    return rows.select(F.explode("packs").alias("p")).select("p.*").withColumnRenamed("id", "pack_id")


def pack(packs: DataFrame, pack_id: str) -> DataFrame:
    """The row of one pack; an unknown id is an error."""
    found = packs.filter(F.col("pack_id") == pack_id)
    if found.isEmpty():
        raise KeyError(f"there is no pack {pack_id}")
    return found


def pack_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path of a pack's files.json, an array of names or an object with files."""
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "files array<string>")["files"])
    return text.select(F.explode(listed).alias("file_path"))
