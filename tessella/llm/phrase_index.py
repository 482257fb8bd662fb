r"""Benchmark decontamination with a distributed positional inverted index.

index() writes the index: each slice of documents is a segment with the postings of all its words, the word's places in
the segment. A document lies in one segment, so a phrase is found where its postings are, and neither building nor
searching shuffles words. matches() searches it for every window of the items: a window's words are taken from the rarest
of the segment on; the places of the rarest, less its offset in the window, are the candidates, and each further posting
list, less its own offset, is intersected with what is left. With slack, words may stand between those of a window:
around each place of the rarest word the others are looked up as the next place after and the last place before, which
is the narrowest stretch through that place.

The items are a stated query set: they are searched in blocks of about BLOCK_BYTES (a window at least), each broadcast,
so the size of what is broadcast doesn't follow the items. Item words are looked up by 64-bit hashes and then compared
with the term's word (two words of one segment with one hash would count as the first).

Defined results: words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, A-Z lower-cased; a null or empty text has none, and an
item without words is never found; an item of fewer words than a window is one window; rows of the index are told apart
by segment and number, so repeated rows and null or equal ids each get their own figures; equal items count by id, and an
item without an id hits words but isn't counted; texts of any length are indexed whole (a text longer than a slice is a
segment); without documents the result is empty, without items nothing is hit. Columns but the key aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.shared import written
from tessella.llm.text_arrays import NOT_ALNUM, numbers, planes, ranges, slices, word_hashes, words

WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Candidates that are intersected at once.
STEP = 1 << 20


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index, a row a segment: its number, keys and n_words of its documents; terms (hashes, ascending), spelled and spell_size
    (their words), n_places and places (by term, each less the one before)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("keys", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("n_words", "terms", "spelled", "spell_size", "n_places", "places")]])
    kinds = pa.list_(to_arrow_type(kind))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                segment += 1
                starts, ends, owner = words(data, offsets, NOT_ALNUM)
                h = word_hashes(data, starts, ends)
                order = np.argsort(h, kind="stable")
                h = h[order]
                first = np.flatnonzero(np.r_[np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
                gap = np.diff(order, prepend=0)
                gap[first] = order[first]
                one = order[first]
                size = ends[one] - starts[one]
                blobs = [planes(np.bincount(owner, minlength=hi - lo)), h[first].tobytes(), data[ranges(starts[one], size)].tobytes(), planes(size), planes(np.diff(first, append=len(h))), planes(gap)]
                keys = b.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(kinds), *[pa.array([x], pa.binary()) for x in blobs]], schema.names)

    return written(rows.mapInArrow(build, schema), "postings")


class Windows:
    """Distinct windows of a block of items: numbers of their terms (-1 behind a short one's end), and each window's items."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        spelled = sorted({w for _, ws in rows for w in ws})
        raw = [w.encode() for w in spelled]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        h = word_hashes(data, np.r_[0, ends[:-1]], ends) if raw else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.raw = h[order], [raw[i] for i in order]
        number = {spelled[i]: n for n, i in enumerate(order)}
        self.items = sorted({i for i, _ in rows if i is not None}, key=str)
        item = {i: n for n, i in enumerate(self.items)}
        held: dict[tuple, set] = {}
        for i, ws in rows:
            held.setdefault(tuple(number[w] for w in ws), set()).update([item[i]] if i is not None else [])
        width = max(map(len, held), default=1)
        self.terms = np.full((len(held), width), -1, np.int64)
        for n, t in enumerate(held):
            self.terms[n, : len(t)] = t
        self.sizes = (self.terms >= 0).sum(1)
        self.n_items = np.array([len(x) for x in held.values()], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items
        self.of = np.array([i for x in held.values() for i in sorted(x)], np.int64)


class Postings:
    """Postings of a segment for the terms of a block of windows; a key is the term's number above its place."""

    def __init__(self, segment: dict, windows: Windows):
        self.n_words = numbers(segment["n_words"])
        self.ends = np.cumsum(self.n_words)
        terms, size, count = np.frombuffer(segment["terms"], np.uint64), numbers(segment["spell_size"]), numbers(segment["n_places"])
        at = np.minimum(np.searchsorted(terms, windows.hash), max(len(terms) - 1, 0))
        there = np.flatnonzero(terms[at] == windows.hash) if len(terms) else np.zeros(0, np.int64)
        spelled, end = segment["spelled"], np.cumsum(size)
        same = [spelled[end[a] - size[a] : end[a]] == windows.raw[t] for t, a in zip(there.tolist(), at[there].tolist(), strict=True)]
        there = there[np.array(same, bool)]
        at = at[there]
        self.count = np.zeros(len(windows.hash), np.int64)
        self.count[there] = count[at]
        gaps = numbers(segment["places"])[ranges((np.cumsum(count) - count)[at], count[at])]
        run = np.cumsum(gaps)
        begin = np.cumsum(count[at]) - count[at]
        place = run - np.repeat(run[begin] - gaps[begin], count[at])
        self.keys = np.repeat(there << 32, count[at]) | place
        self.first = np.cumsum(self.count) - self.count

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << 32 | place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of the term from this place on, or -1."""
        at = np.searchsorted(self.keys, term << 32 | place)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == term), key & 0xFFFFFFFF, -1)

    def last(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last place of the term up to this place, or -1."""
        at = np.searchsorted(self.keys, term << 32 | np.maximum(place, 0), "right") - 1
        key = self.keys[np.maximum(at, 0)]
        return np.where((at >= 0) & (place >= 0) & (key >> 32 == term), key & 0xFFFFFFFF, -1)

    def found(self, windows: Windows, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows that occur, where they start and where they end (a word before which), within a document."""
        if not len(self.keys):
            return
        often = np.where(windows.terms >= 0, self.count[windows.terms], np.iinfo(np.int64).max)
        some = np.flatnonzero(often.min(1) > 0)
        order = np.argsort(often[some], axis=1, kind="stable")  # of each window, the rarest first
        anchor = windows.terms[some, order[:, 0]]
        n = self.count[anchor]
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, STEP):
            x = np.arange(lo, min(lo + STEP, int(ends[-1])))
            w = np.searchsorted(ends, x, "right")
            place = self.keys[self.first[anchor[w]] + x - (ends[w] - n[w])] & 0xFFFFFFFF
            yield from self._near(windows, some[w], order[w, 0], place, slack) if slack else self._exact(windows, some[w], order[w], place)

    def _exact(self, windows: Windows, w: np.ndarray, order: np.ndarray, place: np.ndarray):
        start = place - order[:, 0]
        size = windows.sizes[w]
        for k in range(1, windows.terms.shape[1]):
            due = np.flatnonzero(size > k)
            offset = order[due, k]
            ok = np.ones(len(w), bool)
            ok[due] = self.has(windows.terms[w[due], offset], start[due] + offset)
            w, start, order, size = w[ok], start[ok], order[ok], size[ok]
        yield from self._whole(w, start, start + size)

    def _near(self, windows: Windows, w: np.ndarray, offset: np.ndarray, place: np.ndarray, slack: int):
        start, end = place.copy(), place.copy()
        size = windows.sizes[w]
        for k in range(1, windows.terms.shape[1]):
            for side in (1, -1):
                at = offset + side * k
                due = np.flatnonzero((at >= 0) & (at < size))
                t = windows.terms[w[due], at[due]]
                to = self.next(t, end[due] + 1) if side > 0 else self.last(t, start[due] - 1)
                (end if side > 0 else start)[due] = to
                ok = np.ones(len(w), bool)
                ok[due] = to >= 0
                ok &= end - start + 1 <= size + slack
                w, start, end, offset, size = w[ok], start[ok], end[ok], offset[ok], size[ok]
        yield from self._whole(w, start, end + 1)

    def _whole(self, w: np.ndarray, start: np.ndarray, end: np.ndarray):
        ok = (start >= 0) & (np.searchsorted(self.ends, start, "right") == np.searchsorted(self.ends, end - 1, "right"))
        yield w[ok], start[ok], end[ok]


def _of_segment(segment: dict, windows: Windows, slack: int) -> tuple[np.ndarray, tuple, tuple]:
    """n_words of the documents; document, start and end of the stretches that are hit; document and item of what is found."""
    p = Postings(segment, windows)
    total = int(p.ends[-1]) if len(p.ends) else 0
    mark, pairs = np.zeros(total + 1, np.int32), [np.zeros(0, np.int64)]
    for w, start, end in p.found(windows, slack):
        np.add.at(mark, start, 1)
        np.add.at(mark, end, -1)
        pairs.append(np.unique(np.searchsorted(p.ends, start, "right") << 32 | w))
    pair = np.unique(np.concatenate(pairs))
    d, w = pair >> 32, pair & 0xFFFFFFFF
    pair = np.unique(np.repeat(d << 32, windows.n_items[w]) | windows.of[ranges(windows.first_item[w], windows.n_items[w])])
    hit = np.zeros(total + 2, np.int8)
    hit[1:-1] = np.cumsum(mark)[:total] > 0
    borders = np.zeros(total + 1, bool)
    borders[p.ends] = True  # a stretch ends with its document
    start = np.flatnonzero((hit[1:-1] == 1) & ((hit[:-2] == 0) | borders[:-1]))
    end = np.flatnonzero((hit[1:-1] == 1) & ((hit[2:] == 0) | borders[1:])) + 1
    doc = np.searchsorted(p.ends, start, "right")
    begin = p.ends - p.n_words
    return p.n_words, (doc, start - begin[doc], end - begin[doc]), (pair >> 32, pair & 0xFFFFFFFF)


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item and the words of each of its windows."""
    lower = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(f"`{key}`").alias("item"), F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("w")).filter("size(w) > 0")
    return each.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")).alias("w"))


def matches(found: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, slack: int = 0) -> DataFrame:
    """For each document of an index(): key, n_words, hits (start and end of stretches that windows cover, by word number) and
    items (distinct ids of items with such windows). slack 0 finds exact phrases; more lets so many words stand between."""
    spark = found.sparkSession
    asked = written(item_windows(items, key, text, window), "windows")
    n_bytes = asked.agg(F.coalesce(F.sum(F.aggregate("w", F.lit(64), lambda s, x: s + F.octet_length(x) + 8)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(n_bytes) // BLOCK_BYTES))
    item_kind, span = asked.schema["item"].dataType, T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField("segment", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("key", found.schema["keys"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(item_kind))])
    arrow_span, arrow_item = pa.struct([("start", pa.int64()), ("end", pa.int64())]), to_arrow_type(item_kind)

    def search(block: int) -> DataFrame:
        part = asked.filter(F.pmod(F.xxhash64("w"), F.lit(blocks)) == block) if blocks > 1 else asked
        held = spark.sparkContext.broadcast(Windows([(r[0], r[1]) for r in part.toLocalIterator()]))  # about BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = held.value
            ids = pa.array(windows.items, arrow_item)
            for b in batches:
                for n in range(b.num_rows):
                    segment = {c: b.column(c)[n].as_py() for c in b.schema.names if c not in ("keys", "segment")}
                    n_words, hits, named = _of_segment(segment, windows, slack)
                    lists = lambda doc, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n_words) + 1)), pa.int32()), values)  # noqa: B023, E731
                    spans = lists(hits[0], pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in hits[1:]], fields=list(arrow_span)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n_words), b.column("segment")[n].as_py())), pa.array(np.arange(len(n_words)), pa.int32()), b.column("keys").slice(n, 1).flatten(), pa.array(n_words, pa.int64()), spans, lists(named[0], ids.take(pa.array(named[1])))], out.names)

        return found.mapInArrow(run, out)

    whole = search(0)
    for block in range(1, blocks):
        whole = whole.unionByName(search(block))
    if blocks > 1:  # a document has a row a block
        by = whole.groupBy("segment", "no").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        whole = by.withColumn("items", F.array_distinct("items"))
    return whole.select("key", "n_words", united("hits").alias("hits"), "items")


def united(spans: str) -> Column:
    """Stretches in order, those that overlap as one."""
    return F.expr(f"""
        aggregate(array_sort({spans}), cast(array() as array<struct<start: bigint, end: bigint>>), (s, x) ->
            if(size(s) > 0 and x.start < element_at(s, -1).end,
               concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start as start, greatest(element_at(s, -1).end, x.end) as end))),
               concat(s, array(struct(x.start as start, x.end as end)))))""")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW, slack: int = 0) -> DataFrame:
    """matches() of a fresh index, with n_hit (words hit), n_items and contaminated."""
    found = matches(index(docs, key, text), items, item, text, window, slack)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "contaminated": n_hit > 0})


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return contaminated(docs, items).select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
x AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1), lambda k: w[k:k + {WINDOW - 1}])) AS v FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM x),
y AS (SELECT r, n, unnest(range(0, len(w) - n + 1)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k:k + n - 1])) AS v FROM d, n WHERE len(w) >= n),
m AS (SELECT r, y.p, y.n, item_id FROM y JOIN x ON x.n = y.n AND x.v = y.v),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN s ON d.r = s.r"""
