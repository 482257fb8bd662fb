"""An embedder fitted to the documents: TF-IDF of hashed words, reduced by a distributed randomized SVD.

fit() counts in how many documents each of FEATURES hashed words occurs, then multiplies the documents' matrix with a
random one and back ROUNDS times: each task keeps its share of the product (FEATURES x width numbers), shares are added up
by blocks of rows, so what travels and what a task holds depends on FEATURES and not on the documents. The sum's
orthonormal basis, turned by the eigenvectors of its small Gram matrix, is the projection that is stored.

embed_column() projects texts: vectors of length one, as retrieval takes them. Texts that share telling words come near.

Defined results: words are runs of letters and digits, lower-cased; a null or empty text, or one of words that no
document has, has the zero vector; fewer documents than dimensions leave the last ones zero; the same documents give
the same projection up to rounding, whatever their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tessella.operators.lexical import _lowered, _slices, _split
from tessella.sources.workspace import written

#: Hashed words, dimensions of a vector, spare columns of the random matrix, multiplications forth and back.
FEATURES, DIMENSIONS, SPARE, ROUNDS = 1 << 14, 64, 16, 2
#: Rows of the product that are added up in one group; words and numbers that a step holds at once.
PART, WORDS, NUMBERS = 1 << 6, 1 << 18, 1 << 20
SEED = 5


@dataclass
class Embedder:
    """idf of the hashed words, and the projection, a row for each."""

    idf: np.ndarray
    projection: np.ndarray


def features(text: Column, n: int = FEATURES) -> Column:
    """The hashed words of a text, each as often as it occurs."""

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def hashed(texts: pa.Array) -> pa.Array:
        return _hashed(texts, n)

    return hashed(_lowered(text))


def _hashed(texts: pa.Array, n: int) -> pa.Array:
    """Lists of the hashed words: Spark's xxhash64 of each distinct one of some texts at a time, modulo n."""
    parts = []
    for lo, hi in _slices(pc.binary_length(texts), 8 * WORDS):  # bytes
        lists = _split(texts.slice(lo, hi - lo))
        told = lists.flatten().dictionary_encode()
        code = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in told.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(told.dictionary))
        parts.append(pa.ListArray.from_arrays(lists.offsets, pa.array((code.view(np.int64) % n)[told.indices.to_numpy()], pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _weights(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of the entries of a batch; rows have length one."""
    n = len(idf)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(lists, pa.scalar([], lists.type)).flatten().to_numpy(zero_copy_only=False)
    key, count = np.unique(np.repeat(np.arange(len(lists)), sizes) * n + flat, return_counts=True)
    row, feature = np.divmod(key, n)
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, len(lists)))
    return row, feature, value / np.where(norm[row] > 0, norm[row], 1)


def _multiplied(row: np.ndarray, feature: np.ndarray, value: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """n sparse rows (row: ascending) times the matrix."""
    out = np.zeros((n, matrix.shape[1]))
    step = max(1, NUMBERS // matrix.shape[1])
    for lo in range(0, len(row), step):  # entries of a step
        r = row[lo : lo + step]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(value[lo : lo + step, None] * matrix[feature[lo : lo + step]], first, axis=0)
    return out


def _product(held: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A' A times the matrix, A being the documents' weights."""
    sent = held.sparkSession.sparkContext.broadcast((idf, matrix))  # FEATURES x width numbers

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, matrix = sent.value
        total = np.zeros_like(matrix)
        for lists in (b.column(0).slice(lo, hi - lo) for b in batches for lo, hi in _slices(pc.list_value_length(b.column(0)), WORDS)):
            row, feature, value = _weights(lists, idf)
            there = _multiplied(row, feature, value, matrix, len(lists))
            order = np.argsort(feature, kind="stable")
            total += _multiplied(feature[order], row[order], value[order], there, len(idf))
        parts = range(0, len(idf), PART)
        yield pa.RecordBatch.from_arrays([pa.array([p // PART for p in parts], pa.int32()), pa.array([total[p : p + PART].tobytes() for p in parts], pa.binary())], ["part", "numbers"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for t in tables:
            for x in t.column("numbers"):
                total = total + np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "numbers"])

    shares = held.mapInArrow(share, "part int, numbers binary")
    found = {r.part: np.frombuffer(r.numbers) for r in shares.groupBy("part").applyInArrow(add, "part int, numbers binary").collect()}  # FEATURES x width numbers
    return np.concatenate([found[p] for p in sorted(found)]).reshape(matrix.shape) if found else np.zeros_like(matrix)


def fit(docs: DataFrame, text: str = "content", dimensions: int = DIMENSIONS, n: int = FEATURES) -> Embedder:
    """The embedder of these documents."""
    held = written(docs.select(features(F.col(f"`{text}`"), n).alias("f")), "features")
    df = np.zeros(n)
    for r in held.select(F.explode(F.array_distinct("f")).alias("f")).groupBy("f").count().collect():  # FEATURES rows
        df[r[0]] = r[1]
    total = held.filter("size(f) > 0").count()
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0)
    width = min(n, dimensions + SPARE)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_product(held, idf, basis))[0]
    inner = basis.T @ _product(held, idf, basis)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-value)[:dimensions]
    turned = basis @ vector[:, best]
    turned *= np.where(turned[np.abs(turned).argmax(0), np.arange(turned.shape[1])] < 0, -1, 1)  # signs are free
    turned[:, value[best] <= 1e-9 * max(value.max(initial=0), 1e-300)] = 0
    return Embedder(idf, np.pad(turned, ((0, 0), (0, dimensions - turned.shape[1]))))


def save(embedder: Embedder, spark: SparkSession, path: str) -> None:
    """The stored projection: a row for each hashed word."""
    rows = [(i, float(embedder.idf[i]), embedder.projection[i].tolist()) for i in range(len(embedder.idf))]
    spark.createDataFrame(rows, "feature int, idf double, weights array<double>").write.parquet(path)


def load(spark: SparkSession, path: str) -> Embedder:
    rows = sorted(spark.read.parquet(path).collect())
    return Embedder(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def embed_column(spark: SparkSession, embedder: Embedder) -> Callable[[Column], Column]:
    """A function from a text column to its vectors, for chunks, questions and sync()."""
    held = spark.sparkContext.broadcast((embedder.idf, embedder.projection))  # FEATURES x dimensions numbers

    @arrow_udf(T.ArrayType(T.FloatType()))
    def project(texts: pa.Array) -> pa.Array:
        idf, projection = held.value
        lists = _hashed(texts, len(idf))
        out = np.empty((len(lists), projection.shape[1]), np.float32)
        for lo, hi in _slices(pc.list_value_length(lists), WORDS):
            some = _multiplied(*_weights(lists.slice(lo, hi - lo), idf), projection, hi - lo)
            norm = np.sqrt((some * some).sum(1))
            out[lo:hi] = some / np.where(norm > 1e-12, norm, 1)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

    return lambda c: project(_lowered(c))
