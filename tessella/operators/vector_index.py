"""Nearest neighbours by an index of inverted lists that skips vectors and still finds exactly the nearest ones.

build() trains centroids on a bounded sample, gives every vector to the list of its nearest centroid with its distance
from it, and writes the vectors in the order of list and distance, numbered in blocks of BLOCK. search() first looks at
the blocks around each query's own distance in its PROBES nearest lists; the k-th distance found bounds what can matter.
By the triangle inequality a vector at distance t from its centroid is at least |t - d| from a query at distance d from
it, so only blocks whose range of t comes within the bound are looked at further, and the result is that of knn(). How
much that skips is up to the vectors (looked_at() tells): clustered ones let most blocks go, while vectors spread evenly
over a sphere of many dimensions are all about as far from everything. Where more than a share of the blocks is left,
search() reads them all once, as knn() does, rather than pair by pair.

Distances are Euclidean inside: cosine works on vectors of length one, and the inner product on vectors with one more
number, which gives all of them the same length. Blocks meet queries in a join by block, with a group's queries dealt
out in chunks; vectors of one hot list, or many copies of one, are spread over files and blocks like any others.

Defined results: those of knn(): null vectors are nothing, ties go by key; a condition only passes over vectors, so a
query that finds fewer than k in its first blocks looks at all lists; an index of no vectors finds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.operators.vectors import METRICS, _matrix, _nearest, knn, where
from tessella.sources.workspace import written

#: Vectors of a block, lists that are looked at first, most lists, and numbers in the sample that trains their centroids.
BLOCK, PROBES, MOST_LISTS, SAMPLE_NUMBERS = 256, 2, 4096, 1 << 23
#: Bytes of vectors in a file, and queries that meet a block at once.
FILE_BYTES, CHUNK = 64 << 20, 512
ROUNDS, SEED = 8, 11


@dataclass
class VectorIndex:
    """rows: _list, _block, _away (from the centroid), key, vector and the base's other columns, but for those of these names;
    blocks: block, list, n, low, high."""

    rows: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    metric: str
    longest: float


def _placed(x: np.ndarray, metric: str, longest: float, query: bool = False) -> np.ndarray:
    """Vectors where Euclidean distances order as the metric does."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nan_to_num(x / np.sqrt((x * x).sum(1))[:, None])
    if metric == "ip":
        return np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))]
    return x


def _away(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of all vectors from all centroids."""
    out = np.empty((len(x), len(centroids)))
    for lo in range(0, len(x), step := max(1, (1 << 22) // max(1, centroids.size))):
        out[lo : lo + step] = np.sqrt(((x[lo : lo + step, None] - centroids) ** 2).sum(-1))
    return out


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the distance from it."""
    rough = (centroids * centroids).sum(1) - 2 * x @ centroids.T
    best = rough.argmin(1)  # any list would do, as the distance from its own centroid is what counts
    return best, np.sqrt(((x - centroids[best]) ** 2).sum(1))


def _trained(x: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    c = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(ROUNDS):
        own, _ = _nearest_list(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def build(base: DataFrame, path: str, key: str = "key", vector: str = "vector", metric: str = "l2", lists: int | None = None) -> VectorIndex:
    """Writes the index of base below path. lists: by default the root of the number of vectors, MOST_LISTS at most."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = base.sparkSession
    others = [c for c in base.columns if c not in (key, vector) and c.lower() not in {"key", "vector", "_list", "_block", "_away"}]
    rows = base.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), *[F.col(f"`{c}`") for c in others])
    length = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    n, longest, width = rows.agg(F.count("*"), F.sqrt(F.max(length)), F.max(F.size("vector"))).first()
    longest, width = float(longest or 0), int(width or 1)
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS))
    most = max(lists, SAMPLE_NUMBERS // width)
    sample = rows.select("vector").sample(min(1.0, 1.2 * most / max(n, 1)), SEED).limit(most) if n > most else rows.select("vector")
    x = np.array([r[0] for r in sample.collect()], np.float64).reshape(-1, width)
    centroids = _trained(_placed(x, metric, longest), lists) if len(x) else np.zeros((1, width + (metric == "ip")))
    held = spark.sparkContext.broadcast(centroids)
    schema = T.StructType([T.StructField("_list", T.IntegerType()), T.StructField("_away", T.DoubleType()), *rows.schema])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, away = _nearest_list(_placed(_matrix(b.column(1)), metric, longest), held.value)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(away), *b.columns], schema.names)

    files = max(1, -(-n * width * 4 // FILE_BYTES))
    # Copies of a vector are as far away as each other, so the key parts them.
    ordered = rows.mapInArrow(assign, schema).repartitionByRange(files, "_list", "_away", F.xxhash64("key")).sortWithinPartitions("_list", "_away")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, taken = (TaskContext.get().partitionId() << 32) - 1, -1, 0
        for b in batches:
            if b.num_rows:
                own, at = b.column(0).to_numpy(), np.arange(b.num_rows)
                begins = np.r_[own[0] != last, own[1:] != own[:-1]]
                begin = np.maximum.accumulate(np.where(begins, at, -1))
                place = np.where(begin < 0, at + taken, at - begin)  # in the list
                blocks = block + np.cumsum(place % BLOCK == 0)
                block, last, taken = int(blocks[-1]), own[-1], int(place[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(blocks), *b.columns], ["_block", *schema.names])

    ordered.mapInArrow(number, T.StructType([T.StructField("_block", T.LongType()), *schema])).write.parquet(f"{path}/rows")
    spark.read.parquet(f"{path}/rows").groupBy(F.col("_block").alias("block")).agg(F.first("_list").alias("list"), F.count("*").alias("n"), F.min("_away").alias("low"), F.max("_away").alias("high")).write.parquet(f"{path}/blocks")
    told = spark.createDataFrame([(metric, longest, [c.tolist() for c in centroids])], "metric string, longest double, centroids array<array<double>>")
    told.coalesce(1).write.parquet(f"{path}/lists")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    told = spark.read.parquet(f"{path}/lists").first()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), np.array(told.centroids), told.metric, told.longest)


def _asked(queries: DataFrame, match: str | None) -> DataFrame:
    some = queries.filter(F.col("vector").isNotNull() & (F.col(match).isNotNull() if match else F.lit(True)))
    return some.select("query_id", F.col("vector").cast("array<float>").alias("vector"), *([F.col(match).cast("string").alias("m")] if match else []))


def _first_blocks(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """query_id and block, in the PROBES nearest lists of each query the block around the query's own distance."""
    held, metric, longest = asked.sparkSession.sparkContext.broadcast(index.centroids), index.metric, index.longest
    schema = T.StructType([asked.schema["query_id"], T.StructField("list", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _away(_placed(_matrix(b.column(1)), metric, longest, True), held.value)
                n = min(PROBES, d.shape[1])
                best = np.argsort(d, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(d)), n))), pa.array(best.ravel(), pa.int32()), pa.array(np.take_along_axis(d, best, 1).ravel())], schema.names)

    gap = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
    both = asked.select("query_id", "vector").mapInArrow(near, schema).join(index.blocks, "list")
    return both.groupBy("query_id", "list").agg(F.min_by("block", F.struct(gap, "block")).alias("block")).select("query_id", "block")


def _blocks_within(index: VectorIndex, bounds: DataFrame) -> DataFrame:
    """query_id and block of all blocks that may have a vector within each query's bound. bounds: query_id, vector, bound."""
    held, metric, longest = bounds.sparkSession.sparkContext.broadcast(index.centroids), index.metric, index.longest
    range_of = {r[0]: (r[1], r[2]) for r in index.blocks.groupBy("list").agg(F.min("low"), F.max("high")).collect()}  # MOST_LISTS rows
    low, high = (np.array([range_of.get(i, (np.inf, -np.inf))[s] for i in range(len(index.centroids))]) for s in (0, 1))
    schema = T.StructType([bounds.schema["query_id"], T.StructField("list", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("bound", T.DoubleType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, bound = _away(_placed(_matrix(b.column(1)), metric, longest, True), held.value), b.column(2).to_numpy(zero_copy_only=False)
                row, at = np.nonzero(np.maximum(low - d, d - high) <= bound[:, None])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(d[row, at]), pa.array(bound[row])], schema.names)

    both = bounds.select("query_id", "vector", "bound").mapInArrow(within, schema).join(index.blocks, "list")
    return both.filter((F.col("low") - F.col("far") <= F.col("bound")) & (F.col("far") - F.col("high") <= F.col("bound"))).select("query_id", "block")


def _found(index: VectorIndex, asked: DataFrame, pairs: DataFrame, k: int, condition: dict | None, match: str | None) -> DataFrame:
    """query_id, key, distance and reach (the distance in the index's space) of the best k of each pair of a query and a block."""
    metric, longest = index.metric, index.longest
    sized = pairs.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    dealt = pairs.join(sized, "block").join(asked, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), "_chunks").alias("_chunk")).agg(F.collect_list(F.struct(*asked.columns)).alias("q"))
    columns = [F.col("_block").alias("block"), F.struct("key", "vector", *([F.col(match).cast("string").alias("m")] if match else [])).alias("x")]
    rows = index.rows.filter(where(condition) & (F.col(match).isNotNull() if match else F.lit(True))).select(*columns)
    packed = T.StructType([T.StructField("block", T.LongType()), T.StructField("x", T.ArrayType(rows.schema["x"].dataType))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block = b.column(0).to_numpy()
                cut = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), b.column(1))], packed.names)

    both = rows.mapInArrow(pack, packed).join(dealt, "block").select("q", "x")
    schema = T.StructType([asked.schema["query_id"], T.StructField("key", index.rows.schema["key"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("reach", T.DoubleType())])
    kind = to_arrow_type(schema["query_id"].dataType)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                q, x = (b.column(c).slice(n, 1).flatten() for c in (0, 1))
                (ids, vectors, *wanted), (keys, base, *marks) = q.flatten(), x.flatten()
                at, m = pa.array(np.arange(len(ids))), _matrix(vectors)
                length = (m * m).sum(1)
                for part in _nearest(at, m, wanted[0].to_pylist() if wanted else None, keys, _matrix(base), marks[0].to_pylist() if marks else None, k, metric):
                    who, d = part.column(0).to_numpy(), part.column(2).to_numpy()
                    reach = d if metric == "l2" else 2 * d if metric == "cosine" else longest**2 + length[who] - 2 * (1 - d)
                    yield pa.RecordBatch.from_arrays([ids.take(part.column(0)).cast(kind), part.column(1), part.column(2), pa.array(np.sqrt(np.maximum(reach, 0)))], schema.names)

    return both.mapInArrow(near, schema)


def _bounded(index: VectorIndex, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """asked with bound: the reach of the k-th nearest found so far and what rounding may hide; no bound where there are fewer."""
    reach = found.groupBy("query_id").agg(F.sort_array(F.collect_list("reach")).alias("_r"))  # k a block looked at
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    slack = F.lit(1e-6) * (length + index.longest + 1)
    return asked.join(reach, "query_id", "left").withColumn("bound", F.coalesce(F.try_element_at("_r", F.lit(k)) * (1 + 1e-9) + slack, F.lit(float("inf")))).drop("_r")


def search(index: VectorIndex, queries: DataFrame, k: int = 5, condition: dict | None = None, match: str | None = None, share: float = 0.5) -> DataFrame:
    """query_id, key, distance and rank as of knn(), of queries (query_id, vector and, for match, a column of that name).

    share: of all pairs of a query and a block, those that may be left before all vectors are read instead."""
    asked = _asked(queries, match)
    first = _first_blocks(index, asked)
    seen = written(_found(index, asked, first, k, condition, match), "seen")
    more = written(_blocks_within(index, _bounded(index, asked, seen, k)).join(first, ["query_id", "block"], "left_anti"), "pairs")
    if more.count() > share * asked.count() * index.blocks.count():
        return knn(queries, index.rows, k, index.metric, condition, match)
    found = seen.unionByName(_found(index, asked, more, k, condition, match)).drop("reach")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def looked_at(index: VectorIndex, queries: DataFrame, k: int = 5, condition: dict | None = None, match: str | None = None) -> DataFrame:
    """query_id, n_vectors and n_looked_at of a search: the vectors of the index, and those of the blocks that it reads."""
    asked = _asked(queries, match)
    first = _first_blocks(index, asked)
    more = _blocks_within(index, _bounded(index, asked, _found(index, asked, first, k, condition, match), k))
    read = first.unionByName(more).distinct().join(index.blocks.select("block", "n"), "block")
    total = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"))
    return read.groupBy("query_id").agg(F.sum("n").alias("n_looked_at")).join(F.broadcast(total))  # one row
