"""Retrieval pipeline: route, expand, search, fuse, rerank, sources, prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import models
from tessella.functions.text import checked_strategy, classify_strategy, strip, with_original
from tessella.operators.memory import rewrite
from tessella.operators.vectors import knn
from tessella.sources.workspace import written

K = 5
# The prompt's wording.
SYSTEM_PROMPT = (
    "You are a helpful AI assistant for a personal knowledge base. Answer the user's question based on the provided context from their documents. "
    "If the context doesn't contain relevant information, say so honestly. Cite the source file paths when referencing specific information."
)
WITH_CONTEXT, WITHOUT_CONTEXT = "Context from knowledge base:\n\n", "No relevant context was found in the knowledge base.\n\n"


def first_wins(hits: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """One hit of each query and chunk, the first in this order, with its place among those kept (ordinal)."""
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", *chunk).orderBy(*order))).filter("_n = 1").drop("_n")
    return once.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rerank(hits: DataFrame, score: Column, top_k: int = K, prior: str = "ordinal") -> DataFrame:
    """The top_k hits of each query by score, ties in their prior order."""
    scored = hits.withColumn("rerank_score", score)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), prior))
    return scored.withColumn("_place", place).filter(F.col("_place") <= top_k).drop(prior).withColumnRenamed("_place", prior)


def sources(hits: DataFrame, path: str = "file_path", order: str = "ordinal") -> DataFrame:
    """query_id, path and its place: distinct sources as first seen."""
    first = hits.groupBy("query_id", path).agg(F.min(order).alias("_first"))
    return first.select("query_id", path, F.row_number().over(Window.partitionBy("query_id").orderBy("_first", path)).alias("place"))


def context(hits: DataFrame, path: str = "file_path", content: str = "content", order: str = "ordinal") -> DataFrame:
    line = F.concat(F.lit("[Source: "), F.col(path), F.lit("]\n"), F.col(content))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))  # k lines a query
    return listed.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, custom: str = "", **names) -> DataFrame:
    """query_id and messages: array of role and content."""
    both = questions.join(context(hits, **names), "query_id", "left")
    user = F.when(F.col("context").isNull(), F.concat(F.lit(WITHOUT_CONTEXT + "Question: "), "question")).otherwise(F.concat(F.lit(WITH_CONTEXT), "context", F.lit("\n\nQuestion: "), "question"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    system = F.lit(SYSTEM_PROMPT + (f"\n\n{custom}" if custom else ""))
    return both.select("query_id", F.array(message("system", system), message("user", user)).alias("messages"))


def variants(questions: DataFrame, setting: str = "auto", classify: Callable | None = None, imagine: Callable | None = None, expand: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, question, strategy, variant_no, variant: one row for each text to search for.

    setting: auto (rules), auto_llm (classify, checked by the rules) or a strategy. Row by row: hyde searches for the
    imagined passage, multi_query for the question and its expansions, everything else for the question.
    """
    q = F.col("question")
    strategy = classify_strategy(q) if setting == "auto" else checked_strategy(classify(q) if classify else F.lit(None), q) if setting == "auto_llm" else F.lit(setting)
    expanded = with_original(F.coalesce(expand(q), F.array(q)), q) if expand else F.array(q)
    texts = F.when(F.col("strategy") == "hyde", F.array(models.hypothetical_passage(q, imagine))).when(F.col("strategy") == "multi_query", expanded).otherwise(F.array(q))
    routed = questions.withColumn("strategy", strategy)
    return routed.select("query_id", "question", "strategy", F.posexplode(texts).alias("variant_no", "variant"))


def answer_prompts(questions: DataFrame, chunks: DataFrame, k: int = K, condition: dict | None = None, rerank_hits: bool = False, embed: Callable = models.embed, score: Callable = models.overlap_score, custom: str = "", metric: str = "l2", **routing) -> dict[str, DataFrame]:
    """The pipeline up to the prompt over questions (query_id, question) and chunks (file_path, chunk_index, content, embedding, ...).

    Gives variants, hits, sources and prompts. Pools of several variants aren't cut to k unless reranked.
    """
    texts = variants(questions, **routing)
    asked = texts.select(F.struct("query_id", "variant_no").alias("query_id"), embed(F.col("variant")).alias("vector"))
    keyed = chunks.withColumn("key", F.struct("file_path", "chunk_index"))
    near = knn(asked, keyed, k, metric, condition, vector="embedding").select("query_id.*", "key.*", "rank", "distance")
    hits = first_wins(near, ["file_path", "chunk_index"], ["variant_no", "rank"]).join(chunks.select("file_path", "chunk_index", "content"), ["file_path", "chunk_index"])
    if rerank_hits:
        hits = hits.join(questions.select("query_id", "question"), "query_id")
        hits = rerank(hits, score(F.col("question"), F.col("content"))).drop("question")
    hits = written(hits, "hits")  # sources and prompts come from them
    return {"variants": texts, "hits": hits, "sources": sources(hits), "prompts": prompts(questions, hits, custom)}


def answers(questions: DataFrame, chunks: DataFrame, model: Callable[[Column], Column], messages: DataFrame | None = None, summaries: DataFrame | None = None, turns: int = 0, by: list[str] | None = None, rewriter: Callable | None = None, **how) -> DataFrame:
    """The whole pipeline: memory, rewriting, routing, expansion, search, fusion, reranking, prompt and answer.

    questions: query_id, question and the columns of by; model: the messages (array of role and content) to an answer.
    Gives query_id, question (as rewritten), strategy, sources (array of paths), answer, error: a null or blank answer is
    an error, and so is a null or blank question, which isn't searched for. With turns > 0 the question is rewritten by the conversation's summaries and last messages.
    """
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    refused = questions.filter(blank).select("query_id", "question", F.lit(None).cast("string").alias("strategy"), F.array().cast("array<string>").alias("sources"), F.lit(None).cast("string").alias("answer"), F.lit("the question is blank").alias("error"))
    questions = questions.filter(~blank)
    asked = rewrite(questions, messages, summaries, turns, by or [], rewriter) if turns > 0 else questions
    out = answer_prompts(asked.select("query_id", "question"), chunks, **how)
    found = out["sources"].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "file_path"))).alias("s")).select("query_id", F.col("s.file_path").alias("sources"))
    routed = out["variants"].filter("variant_no = 0").select("query_id", "question", "strategy")
    told = out["prompts"].select("query_id", models.or_else(model, F.col("messages"), F.lit(None).cast("string")).alias("answer"))
    both = routed.join(found, "query_id", "left").join(told, "query_id")
    out = both.select("query_id", "question", "strategy", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "answer", F.when(F.col("answer").isNull(), "the model gave no answer").alias("error"))
    return out.unionByName(refused)
