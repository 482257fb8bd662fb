"""Retrieval evaluation: whether questions find what is relevant, and report rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import positions

ACCEPTED = 0.8


def question_scores(hits: DataFrame, relevant: str = "relevant") -> DataFrame:
    """query_id, hit, n_relevant and reciprocal_rank of each question's ranked hits (query_id, rank, relevant)."""
    r = F.col(relevant)
    return hits.groupBy("query_id").agg(F.max(r.cast("int")).alias("hit"), F.count_if(r).alias("n_relevant"), F.coalesce(1.0 / F.min(F.when(r, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))


def report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the mean of each metric to four places, and the number of questions."""
    return scores.agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def accepted(scores: DataFrame) -> DataFrame:
    """One row: the share of questions with a hit, and whether it is enough (8 in 10)."""
    return scores.agg(F.avg("hit").alias("hit_rate")).withColumn("accepted", F.col("hit_rate") >= ACCEPTED)


def evaluate(questions: DataFrame, results: DataFrame, judges: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """Questions (no, question, ground_truth) beside their answers and sources (no, answer, sources), matched by position,
    with answered, n_sources and the score of each judge; a question without a result is an unanswered one."""
    both = questions.join(results.select("no", "answer", "sources"), "no", "left")
    both = both.withColumns({"answered": (F.col("answer").isNotNull()).cast("int"), "n_sources": F.coalesce(F.size("sources"), F.lit(0))})
    for name, judge in (judges or {}).items():
        both = both.withColumn(name, judge(both))
    return both


def numbered(questions: DataFrame, order: list[str]) -> DataFrame:
    """questions with no, their position from 0."""
    return positions.numbered(questions, order)
