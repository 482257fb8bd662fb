"""Ingest tasks: the log of a task's files rolled up to its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.catalog import progress
from tessella.operators.memory import ordered_text


def roll_up(log: DataFrame) -> DataFrame:
    """task_id, total_files, processed_files, errors (a line each, by file), status, percent.

    log: task_id, file_path, done (whether it was tried), error. failed with any error, completed when all files were
    tried, else running.
    """
    counts = log.groupBy("task_id").agg(F.count("*").alias("total_files"), F.count_if("done").alias("processed_files"))
    lines = log.filter("error is not null").groupBy("task_id").agg(ordered_text("file_path", F.col("error")).alias("errors"))
    both = counts.join(lines, "task_id", "left")
    status = F.when(F.col("processed_files") < F.col("total_files"), "running").when(F.col("errors").isNotNull(), "failed").otherwise("completed")
    return both.withColumns({"status": status, "percent": progress(F.col("processed_files"), F.col("total_files"))})


def task(tasks: DataFrame, task_id: str) -> DataFrame:
    """The task's row; none for an unknown id."""
    return tasks.filter(F.col("id") == task_id)


def start(tasks: DataFrame, task_id: str, total: int, now: Column) -> DataFrame:
    """tasks with a new one that is pending; an id that is taken is an error."""
    new = tasks.sparkSession.range(1).select(F.lit(task_id).alias("id"), F.lit("pending").alias("status"), F.lit(total).cast("long").alias("total_files"), F.lit(0).cast("long").alias("processed_files"), F.lit(None).cast("string").alias("errors"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    both = tasks.unionByName(new, allowMissingColumns=True)
    taken = both.groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("id") == task_id)
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"the task {task_id} exists")).cast("boolean"))
    return both.join(F.broadcast(taken), "id", "left").filter(F.col("_n").isNull() | ok).drop("_n")


def advance(tasks: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """tasks as their log (see roll_up) says: running, completed or failed; finished ones stay as they are, with their moment."""
    done = roll_up(log).select(F.col("task_id").alias("id"), F.col("processed_files").alias("_p"), F.col("errors").alias("_e"), F.col("status").alias("_s"))
    both = tasks.join(done, "id", "left")
    moves = F.col("_s").isNotNull() & F.col("status").isin("pending", "running")
    set_to = {"processed_files": F.col("_p"), "errors": F.col("_e"), "status": F.col("_s"), "completed_at": F.when(F.col("_s") != "running", now)}
    return both.select(*[F.when(moves, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in tasks.columns])
