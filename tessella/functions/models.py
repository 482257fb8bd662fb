"""Pluggable model steps with deterministic offline defaults. The defaults stand in for models; they are none.

Embedder: hashed words, normalised. Reranker: share of the question's words in a chunk. Language model: absent, so each
step takes its fallback: the question itself, the rules' strategy, no summary. PDF text: an error row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessella.functions.text import strip

DIMENSION = 64


def embed_text(text: str | None) -> list[float]:
    v = np.zeros(DIMENSION)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % DIMENSION] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


@pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)


def overlap_score(question: Column, content: Column) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != ""))
    q = words(question)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(content))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def or_else(model: Callable[[Column], Column] | None, given: Column, fallback: Column) -> Column:
    """The model's stripped answer; the fallback without a model or where the answer is null or blank."""
    return fallback if model is None else F.coalesce(F.nullif(strip(model(given)), F.lit("")), fallback)


def hypothetical_passage(question: Column, model: Callable[[Column], Column] | None = None) -> Column:
    return or_else(model, question, question)


def standalone_question(question: Column, prompt: Column, has_context: Column, model: Callable[[Column], Column] | None = None) -> Column:
    return F.when(has_context, or_else(model, prompt, question)).otherwise(question)


def summary(conversation: Column, model: Callable[[Column], Column] | None = None) -> Column:
    return or_else(model, conversation, F.lit(""))


# The embedding models to choose from, by language, with their size in MB.
MODELS = [("english", "all-MiniLM-L6-v2", 80), ("chinese", "bge-small-zh", 400), ("mixed", "bge-m3", 1200)]


def registry(files: DataFrame) -> DataFrame:
    """language, model, size_mb and downloaded: whether the models folder has any file (file_path below it) of the model."""
    have = files.select(F.substring_index("file_path", "/", 1).alias("folder")).distinct()
    known = files.sparkSession.createDataFrame(MODELS, "language string, model string, size_mb int")
    found = known.join(have, F.col("folder").endswith(F.col("model")), "left")
    return found.groupBy("language", "model", "size_mb").agg(F.max(F.col("folder").isNotNull()).alias("downloaded"))
