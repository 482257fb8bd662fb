"""Conversation memory: history pages, the last messages, and compression above a watermark (the highest summarised id).

Conversations are told apart by the columns in `by`; the default is one history for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.models import standalone_question, summary
from tessella.functions.text import transcript_line

THRESHOLD = 20
MOST_PER_PAGE = 500
# The wording of the rewriting prompt.
REWRITE_TASK = (
    "Given the conversation history below and a follow-up question, rewrite the follow-up question to be a standalone question that captures the full context. "
    "Do not answer the question — just rewrite it.\n\n"
)
SUMMARIES_TITLE, HISTORY_TITLE, QUESTION_TITLE, REWRITE_END = "Earlier conversation summaries:\n", "Conversation history:\n", "Follow-up question: ", "\n\nStandalone question:"


def history_page(messages: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the history by id."""
    if not 1 <= limit <= MOST_PER_PAGE or offset < 0:
        raise ValueError("limit is 1 to 500 and offset at least 0")
    return messages.orderBy("id").offset(offset).limit(limit)


def last_messages(messages: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The last n messages of each conversation; none when n <= 0. They are messages, not pairs of turns."""
    by = by or []
    if n <= 0:
        return messages.limit(0)
    if not by:
        return messages.orderBy(F.desc("id")).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("id")))
    return messages.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def ordered_text(order: str, line: Column, separator: str = "\n") -> Column:
    """Aggregate: the lines in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), separator)


def watermarks(summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The highest summarised id of each conversation; without by, one row, 0 when nothing is summarised."""
    mark = F.max("last_message_id")
    return summaries.groupBy(*by).agg(mark.alias("watermark")) if by else summaries.agg(F.coalesce(mark, F.lit(0)).alias("watermark"))


def unsummarised(messages: DataFrame, summaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The messages above the watermark. Without by the watermark is one row, so broadcasting it is bounded."""
    marks = watermarks(summaries, by)
    both = messages.join(marks, by, "left") if by else messages.join(F.broadcast(marks))
    return both.filter(F.col("id") > F.coalesce("watermark", F.lit(0))).drop("watermark")


def compress(messages: DataFrame, summaries: DataFrame, threshold: int = THRESHOLD, by: list[str] | None = None, model=None) -> DataFrame:
    """New summary rows: by, n_messages, first_message_id, last_message_id, transcript, summary.

    A conversation is due when at least threshold messages are above its watermark; all of them are summarised. With a
    threshold <= 0 none is. Rows whose summary is blank aren't to be stored, so the watermark stays (see advance()).
    """
    by = by or []
    open_ = unsummarised(messages, summaries, by)
    n, line = F.count("*"), transcript_line("role", "content")
    due = open_.groupBy(*by).agg(n.alias("n_messages"), F.min("id").alias("first_message_id"), F.max("id").alias("last_message_id"), ordered_text("id", line).alias("transcript"))
    due = due.filter(F.lit(threshold > 0) & (F.col("n_messages") >= threshold))
    return due.withColumn("summary", summary(F.col("transcript"), model))


def advance(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """summaries with the new ones that aren't blank."""
    return summaries.unionByName(new.filter("summary <> ''").select(*[c for c in new.columns if c in summaries.columns]), allowMissingColumns=True)


def rewrite_prompts(questions: DataFrame, messages: DataFrame, summaries: DataFrame, turns: int, by: list[str]) -> DataFrame:
    """The columns of questions, has_context and prompt: all summaries, the last messages, then the question."""
    recent = last_messages(messages, turns, by).groupBy(*by).agg(ordered_text("id", transcript_line("role", "content")).alias("_recent"))
    told = summaries.groupBy(*by).agg(ordered_text("id", F.col("summary"), "\n\n").alias("_told"))
    both = questions.join(recent, by, "left").join(told, by, "left")
    summed = F.when(F.col("_told").isNotNull(), F.concat(F.lit(SUMMARIES_TITLE), "_told", F.lit("\n\n"))).otherwise("")
    prompt = F.concat(F.lit(REWRITE_TASK), summed, F.lit(HISTORY_TITLE), F.coalesce("_recent", F.lit("")), F.lit("\n\n" + QUESTION_TITLE), F.col("question"), F.lit(REWRITE_END))
    return both.select(*[questions[c] for c in questions.columns], (F.col("_recent").isNotNull() | F.col("_told").isNotNull()).alias("has_context"), prompt.alias("prompt"))


def rewrite(questions: DataFrame, messages: DataFrame, summaries: DataFrame, turns: int, by: list[str], model: Callable[[Column], Column] | None = None) -> DataFrame:
    """questions with each question made to stand alone; as it is with no turns, no context or no answer of the model."""
    if turns <= 0:
        return questions
    asked = rewrite_prompts(questions, messages, summaries, turns, by)
    new = standalone_question(F.col("question"), F.col("prompt"), F.col("has_context"), model)
    return asked.select(*[(new.alias(c) if c == "question" else F.col(c)) for c in questions.columns])


def clear(messages: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty messages, empty summaries, and one row with the count of what was deleted."""
    return messages.limit(0), summaries.limit(0), messages.agg(F.count("*").alias("deleted"))


def export_rows(messages: DataFrame) -> DataFrame:
    """The history in the order of time, ties by id, as it is exported: role, content, sources, created_at."""
    return messages.orderBy("created_at", "id").select(*[c for c in ("role", "content", "sources", "created_at") if c in messages.columns])
