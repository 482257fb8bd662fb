"""Nearest-neighbour search of a stated query set against all vectors, with metadata filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.sources.workspace import written

#: About so many queries are broadcast at a time.
QUERY_BLOCK = 4096
#: Numbers that a step of the search holds at once.
PAIRS = 1 << 19
METRICS = ("l2", "cosine", "ip")


def where(condition: dict | None) -> Column:
    """A Column of a metadata filter: {field: value}, {field: {$op: value}}, $and and $or. A missing field never matches."""
    ops = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    }
    out = F.lit(True)
    for key, value in (condition or {}).items():
        if key in ("$and", "$or"):
            parts = [where(x) for x in value]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
        elif isinstance(value, dict):
            one = F.lit(True)
            for op, v in value.items():
                if op not in ops:
                    raise ValueError(f"unknown operator {op}")
                one = one & ops[op](F.col(key), v)
        else:
            one = F.col(key) == value
        out = out & F.coalesce(one, F.lit(False))
    return out


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two arrays as a Column, in double precision: squared l2, 1 - cosine, or 1 - inner product."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda u, v: (u.cast("double") - v) * (u.cast("double") - v)), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return 1 - dot(a, b)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return ((x - q) ** 2).sum(-1)
    dot = (x * q).sum(-1)
    return 1 - (dot / np.sqrt((q * q).sum(-1) * (x * x).sum(-1)) if metric == "cosine" else dot)


def knn(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "l2", condition: dict | None = None, match: str | None = None, key: str = "key", vector: str = "vector") -> DataFrame:
    """query_id, key, distance, rank (from 1; ties by key) of each query's k nearest vectors.

    queries: query_id, vector and, for match, a column of that name; only vectors with an equal value are near, and a
    null one equals none. A query or a row without a vector finds and is nothing. The filters come before the distances.
    Each batch of vectors keeps its best k a query by (distance, key), so a query shuffles k rows a batch: rounded
    distances only leave out vectors that their error can't bring among the k. Of equal vectors of a batch only the k first
    keys can be near. QUERY_BLOCK queries are broadcast at a time, and the vectors, which never move, are read once for each
    such block. Where there are more, equal queries are searched for once and get their rows by a join.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    columns = lambda df, name, v: df.filter(F.col(v).isNotNull() & (F.col(match).isNotNull() if match else F.lit(True))).select(F.col(name), F.col(v).cast("array<float>").alias("vector"), *([F.col(match).cast("string").alias("m")] if match else []))
    asked, rows = columns(queries, "query_id", "vector"), columns(base.filter(where(condition)), key, vector).withColumnRenamed(key, "key")
    some = asked.limit(QUERY_BLOCK + 1).collect()
    if len(some) <= QUERY_BLOCK:
        return _ranked(asked, [some], rows, k, metric, match)
    kept, by = written(asked, "queries"), ["vector", "m"] if match else ["vector"]
    once = written(kept.select(by).distinct().select(F.monotonically_increasing_id().alias("query_id"), *by), "vectors")
    near = _ranked(once, _blocks(once), rows, k, metric, match)
    listed = near.groupBy("query_id").agg(F.collect_list(F.struct("key", "distance", "rank")).alias("near"))  # k rows a query
    return kept.join(once.withColumnRenamed("query_id", "_no").join(listed.withColumnRenamed("query_id", "_no"), "_no"), by).select("query_id", F.explode("near").alias("n")).select("query_id", "n.*")


def _ranked(asked: DataFrame, blocks: Iterable[list], rows: DataFrame, k: int, metric: str, match: str | None) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("distance", T.DoubleType())])
    found = None
    for some in blocks:
        part = rows.mapInArrow(_searching(rows.sparkSession, some, to_arrow_type(schema["query_id"].dataType), k, metric, match), schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(kept: DataFrame) -> Iterator[list]:
    """The queries, about QUERY_BLOCK at a time."""
    blocks = -(-kept.count() // QUERY_BLOCK)
    for n in range(blocks):
        yield (kept if blocks == 1 else kept.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).collect()


def _searching(spark: SparkSession, some: list, kind: pa.DataType, k: int, metric: str, match: str | None):
    same = {}
    for r in some:
        same.setdefault((np.array(r[1], np.float64).tobytes(), r[2] if match else None), []).append(r[0])
    held = spark.sparkContext.broadcast((list(same.values()), np.array([np.frombuffer(v) for v, _ in same]), [m for _, m in same] if match else None))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, marks = held.value
        each, counts = pa.array([i for x in ids for i in x], kind), np.array([len(x) for x in ids], np.int64)
        starts = np.cumsum(counts) - counts
        for b in batches:
            if b.num_rows and len(ids):
                names, x, own = _first_of_equal(b.column(0), _matrix(b.column(1)), b.column(2) if match else None, k)
                for rows, at, d in _best(q, marks, names, x, own, k, metric):
                    # The rows of a vector for each of its queries.
                    copies = np.repeat(np.arange(len(rows)), counts[rows])
                    place = np.arange(len(copies)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
                    yield pa.RecordBatch.from_arrays([each.take(pa.array(starts[rows][copies] + place)), names.take(pa.array(at[copies])), pa.array(d[copies])], ["query_id", "key", "distance"])

    return near


def _first_of_equal(names: pa.Array, x: np.ndarray, marks: pa.Array | None, k: int) -> tuple[pa.Array, np.ndarray, list | None]:
    """Keys, vectors and marks without those behind the k first keys of equal vectors."""
    codes = pa.Array.from_buffers(pa.binary(x.dtype.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).dictionary_encode()
    group = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if marks is not None:
        told = marks.dictionary_encode()
        group = group * len(told.dictionary) + told.indices.to_numpy(zero_copy_only=False)
    if len(codes.dictionary) < len(x):
        order = np.lexsort((_places(names), group))
        kept = np.sort(order[np.arange(len(x)) - np.searchsorted(group[order], group[order]) < k])
        names, x, marks = names.take(pa.array(kept)), x[kept], None if marks is None else marks.take(pa.array(kept))
    return names, x, None if marks is None else marks.to_pylist()


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _places(keys: pa.Array) -> np.ndarray:
    """The place of each key in Spark's order, nulls first."""
    out = np.empty(len(keys), np.int64)
    if pa.types.is_floating(keys.type):  # Spark has NaN last
        order = np.lexsort((keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False)))
    elif pa.types.is_struct(keys.type):  # by the first field, then the next
        order = np.lexsort([_places(c) for c in reversed(keys.flatten())])
    else:
        order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
    out[order] = np.arange(len(keys))
    if pa.types.is_struct(keys.type) or not len(keys):
        return out
    # Equal keys share a place, so that the next field of a struct can tell them apart.
    codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    first = np.full(codes.max() + 2, len(keys))
    np.minimum.at(first, codes + 1, out)
    return first[codes + 1]


def _best(q: np.ndarray, wanted: list | None, names: pa.Array, x: np.ndarray, marks: list | None, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, place and distance of the best k by (distance, key) of these vectors for each of these queries."""
    at_key, size = _places(names), (x * x).sum(1)
    slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps
    step = max(1, PAIRS // len(x))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        length = (part * part).sum(1)[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            rough = -2 * part @ x.T + size if metric == "l2" else -(part @ x.T) / (np.sqrt(size) if metric == "cosine" else 1)
        off = slack * (length + size if metric == "l2" else np.sqrt(length) + 0 * size if metric == "cosine" else 1 + np.sqrt(length * size))
        if wanted is not None:
            rough = np.where(np.array(wanted[lo : lo + step], object)[:, None] == np.array(marks, object)[None, :], rough, np.inf)
        ok = np.isfinite(rough)
        n = min(k, len(x))
        last = np.partition(np.where(ok, rough + off, np.inf), n - 1, axis=1)[:, n - 1]  # the k-th distance isn't greater
        rows, at = np.nonzero(ok & (rough - off <= last[:, None]))
        cut = max(1, PAIRS // x.shape[1])
        d = np.concatenate([_distances(part[rows[i : i + cut]], x[at[i : i + cut]], metric) for i in range(0, len(rows), cut)] or [np.zeros(0)])
        order = np.lexsort((at_key[at], d, rows))
        rows, at, d = rows[order], at[order], d[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        yield rows[best] + lo, at[best], d[best]


def _nearest(ids: pa.Array, q: np.ndarray, wanted: list | None, names: pa.Array, x: np.ndarray, marks: list | None, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """_best() with the queries' ids and the keys."""
    for rows, at, d in _best(q, wanted, names, x, marks, k, metric):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), names.take(pa.array(at)), pa.array(d)], ["query_id", "key", "distance"])
