"""Cached document summaries: lookup, what is missing, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import models


def cached(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """The requested files that have a summary."""
    return requests.select("file_path").distinct().join(summaries, "file_path")


def missing(documents: DataFrame, summaries: DataFrame) -> DataFrame:
    return documents.join(summaries.select("file_path"), "file_path", "left_anti")


def upsert(summaries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """summaries with the new texts (file_path, summary, no: the last wins); known files keep created_at."""
    last = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("no"), F.desc("summary")))
    fresh = new.withColumn("_n", last).filter("_n = 1").select("file_path", F.col("summary").alias("_s"))
    both = summaries.join(fresh, "file_path", "full_outer")
    changed = F.col("_s").isNotNull()
    set_to = {"summary": F.col("_s"), "created_at": F.coalesce("created_at", now), "updated_at": now}
    return both.select(*[F.when(changed, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in summaries.columns])


def summarise(documents: DataFrame, summaries: DataFrame, now: Column, model=None) -> DataFrame:
    """summaries with those of the documents (file_path, text) that had none; blank answers aren't kept."""
    made = missing(documents, summaries).select("file_path", models.summary(F.col("text"), model).alias("summary"), F.lit(0).alias("no")).filter("summary <> ''")
    return upsert(summaries, made, now)
