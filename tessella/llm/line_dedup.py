"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

Each task fills both filters from the keys of its lines, a document counting once; the filters of two tasks merge by
once = a | b, twice = ta | tb | (a & b). Only lines whose key may have been seen twice are shuffled, to confirm the
repeat exactly and to choose the smallest document. A filter has at most 2^29 bits (64 MB to broadcast, enough for
some 10^8 lines); over more lines it fills up, which only sends more suspects to the exact step. Keys of more than one
in HOT suspects, so fewer than HOT keys, are broadcast to their lines; the others are joined.

Defined results: null or empty text is one empty line; keys are compared as strings, not as hashes; a null id is
smaller than any other; rows of the same id are one document to the count, and of their lines none is dropped for
another of them, whether their texts are equal or not; a text of any length is split whole; a table without repeats
comes back unchanged, an empty one empty; other columns pass through, and n_lines and n_dropped of dedup_lines()
replace columns of these names, which without_repeats() leaves alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessella.llm.shared import written

LEAST_CHARS = 10
BITS_PER_LINE = 12
LEAST_BITS, MOST_BITS = 20, 29
#: A filter travels in blocks of so many bytes.
BLOCK = 1 << 15
HOT = 1000
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _same (the hash of the text), no, the stripped line and a hash that is equal for equal keys, for the lines whose key is long enough."""
    # The hash stands below the explode, so it is taken once a text, and a line carries no text.
    hashed = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_same"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    each = hashed.select("_id", "_same", F.posexplode(F.split("_text", "\n", -1)).alias("no", "line"))
    stripped = each.select("_id", "_same", "no", F.btrim("line", F.lit(" \t\n\x0b\f\r")).alias("line")).filter(F.length("line") >= LEAST_CHARS)
    return stripped.withColumn("hash", F.xxhash64(F.lower("line")))  # lower() is fast, and only ever joins more than the key does


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.int64).view(np.uint64)
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64), ((h >> np.uint64(64 - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    twice |= more_twice | (once & more_once)
    once |= more_once


def twice_seen(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes seen in two documents or more (and, by chance, of some others)."""
    size = (1 << bits) // 8
    block = min(BLOCK, size)

    def fill(batches):
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for pdf in batches:
            pdf = pdf.drop_duplicates()
            for at in _places(pdf["hash"].to_numpy(), bits):
                place, count = np.unique(at, return_counts=True)
                byte, bit = place >> 3, (128 >> (place & 7)).astype(np.uint8)
                again = (count > 1) | (once[byte] & bit > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        full = np.flatnonzero(once.reshape(-1, block).any(1))
        yield pd.DataFrame({"block": full, "once": [once[i * block : (i + 1) * block].tobytes() for i in full], "twice": [twice[i * block : (i + 1) * block].tobytes() for i in full]})

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(block, np.uint8), np.zeros(block, np.uint8)
        for pdf in batches:
            for o, t in zip(pdf["once"], pdf["twice"], strict=True):
                _merge(once, twice, np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8))
        yield pd.DataFrame({"block": [key[0]], "twice": [twice.tobytes()]})

    parts = found.select("_id", "hash").mapInPandas(fill, "block int, once binary, twice binary")
    whole = parts.groupBy("block").applyInPandas(merge, "block int, twice binary")
    out = np.zeros(size, np.uint8)
    for row in whole.collect():  # 2^MOST_BITS bits at most
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.twice, np.uint8)
    return out


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _same and no of the lines to drop: those with a key of at least two documents, but in the smallest of them."""
    spark = docs.sparkSession
    found = lines(docs, key, text)
    n = found.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * BITS_PER_LINE)), LEAST_BITS, MOST_BITS))
    seen = spark.sparkContext.broadcast(twice_seen(found, bits))

    def suspects(batches):
        for pdf in batches:
            a, b = _places(pdf["hash"].to_numpy(), bits)
            f = seen.value
            yield pdf[((f[a >> 3] >> (7 - (a & 7))) & (f[b >> 3] >> (7 - (b & 7))) & 1).astype(bool)]

    maybe = written(found.mapInPandas(suspects, found.schema).select("_id", "_same", "no", F.translate("line", *_ASCII).alias("key")), "suspects")
    by = maybe.groupBy("key").agg(F.min(F.struct("_id")).alias("_first"), F.max(F.struct("_id")).alias("_last"), F.count("*").alias("_n"))
    by = written(by.filter(~F.col("_first._id").eqNullSafe(F.col("_last._id"))).select("key", F.col("_first._id").alias("_keep"), "_n"), "repeats")
    most = maybe.count() // HOT
    often, seldom = by.filter(F.col("_n") > most), by.filter(F.col("_n") <= most)
    direct = maybe.join(F.broadcast(often), "key")  # fewer than HOT keys
    rest = maybe.join(F.broadcast(often.select("key")), "key", "left_anti").join(seldom, "key")
    return direct.unionByName(rest).filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_same", "no")


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
def _rebuilt(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, n, gone = [], [], []
    for t, drop in zip(texts, drops, strict=True):
        each = (t or "").split("\n")
        lost = set() if drop is None else set(drop)
        kept.append(t if not lost else "\n".join(x for i, x in enumerate(each) if i not in lost))
        n.append(len(each))
        gone.append(len(lost))
    return pd.DataFrame({"text": kept, "n_lines": n, "n_dropped": gone})


def _deduped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_row (the document as it was) and _new: its text without the dropped lines, n_lines (before) and n_dropped."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).withColumn("_same", F.xxhash64("_text"))
    drops = repeats(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text").groupBy("_id", "_same").agg(F.collect_set("no").alias("_drop"))
    drops = drops.withColumnsRenamed({"_id": "_of", "_same": "_like"})
    both = row.join(drops, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_same") == F.col("_like")), "left")
    return both.select("_row", _rebuilt("_text", "_drop").alias("_new"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text replaced by the kept lines, n_lines (before) and n_dropped."""
    names = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}]
    return _deduped(docs, key, text).select(*[F.col("_new.text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in names], "_new.n_lines", "_new.n_dropped")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text replaced by the kept lines, and no other column changed."""
    return _deduped(docs, key, text).select(*[F.col("_new.text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = r"""
  SELECT r, doc_id, unnest(range(len(l))) AS no, unnest(l) AS line,
    translate(regexp_replace(unnest(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})"""
OP10_SQL = f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents), l AS ({LINES_SQL.format(docs="d")}),
k AS (SELECT key, min(doc_id) AS keep FROM l WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
