"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is its set of distinct five-word shingles; two link when 100 * |A & B| >= 80 * |A | B|. Sets fall into size
bands of ratio 1.25, so that linked sets are in the same band or in neighbouring ones; a set is indexed for its own
band and for the next. For a band whose largest size is hi, linked sets differ in at most H = 2 hi / 9 shingles. The
universe of shingle hashes is cut into m segments of equal width. Each band takes the cheaper of two allocations:

* m = H + 1 + spare exact segments: linked sets agree in spare + 1 of them or more. A set may pass over up to spare
  segments, and passes over the ones whose content is frequent (cost-based); its empty segments count as passed over,
  since the other set may not index them, so a set with more empty ones than that passes over nothing else.
* m = H // 2 + 1 segments with their one-deletion neighbourhoods, for small sets: in one segment they differ by at most one.

Equal sets are one node. A set is compared, on the whole texts, with the pivot that it shares most segments with;
what that leaves in other components is compared with all others of its pivots, block by block. So a group of k near
copies takes about k comparisons, no pairs are made, and no component is lost.

Defined results: a text without words is empty and links with nothing; fewer than five words are one shingle; null
ids take part, and a component's id is its smallest non-null id; repeated rows link as equal texts; rows of one id with
different texts are classed each by its own; other columns are ignored by near_duplicates() and kept by one_of_each(),
whatever their names; a text of any length is compared whole, and held whole by one task; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.shared import components, written
from tessella.llm.text_arrays import mix, ranges, shingle_sets

SIZE = 5
#: Segment content of more sets than this is frequent.
FREQUENT = 32
#: Shingles, and sets, in a block of sets that are compared with another block; numbers in a step of that.
BLOCK, BLOCK_SETS, CELLS = 1 << 16, 2048, 1 << 22
#: Bytes of texts whose signatures meet in one group.
MEET_BYTES = 12 << 20
#: Nodes whose signatures a task remembers to have sent.
SEEN = 1 << 19
SALT = 16
#: Up to so many nodes and text hashes (16 bytes each) are broadcast to pick their documents; beyond, the documents are joined.
BROADCAST_IDS = 500_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def bands(most: int = 1 << 31) -> np.ndarray:
    """Least sizes of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, np.int64)


def allocate(hi: int) -> tuple[int, int, int]:
    """(segments, deletions, spare) for pairs of sets up to size hi, by the cost in index rows and in chance meetings."""
    far = 2 * hi // 9
    if not far:
        return 0, 0, 0  # only equal sets link
    spare = max(3, far // 8)
    exact, deleting = far + 1 + spare, far // 2 + 1
    meet = lambda m, few: 40 * m * sum(math.exp(-hi / m) * (hi / m) ** k / math.factorial(k) for k in range(few + 1))
    empty = exact * math.exp(-hi / exact)
    cost_exact = exact + (meet(exact, 0) if empty > spare / 3 else 0)
    cost_deleting = deleting + hi + meet(deleting, 1)
    return (exact, 0, spare) if cost_exact <= cost_deleting else (deleting, 1, 0)


BANDS = bands()
PLAN = np.array([allocate(int(BANDS[i + 1]) - 1) if i + 1 < len(BANDS) else (1, 0, 0) for i in range(len(BANDS))], np.int64)


def _sum_by(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else np.zeros(0, np.uint64)


def set_ids(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit identity of each set."""
    n = np.diff(bounds)
    ids = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    ids[full] = mix(_sum_by(mix(h ^ _B), bounds[:-1][full]) + n[full].astype(np.uint64) * _A)
    return n, ids


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set number, and 0 for the set's own band or 1 for the next, of each indexed segment; and how many
    segments a set may pass over in either band: its spare ones less its empty ones, as the other set may not index those."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    band = np.searchsorted(BANDS, n, "right") - 1
    value, top = mix(h ^ _C), h >> np.uint64(32)
    out, left = [], np.zeros((len(n), 2), np.uint32)
    for step in (0, 1):
        at = np.minimum(band + step, len(BANDS) - 1)
        m, deletions, spare = PLAN[at].T
        use = (m > 0) & (n > 0) & ((step == 0) | (5 * n + 4 >= 4 * BANDS[at]))
        seg = (top * np.maximum(m, 1)[owner].astype(np.uint64)) >> np.uint64(32)  # rises with the hash, so segments are runs
        begins = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool))
        who, which, total = owner[begins], seg[begins], _sum_by(value, begins)
        salt = lambda w, s: mix((at[w].astype(np.uint64) << np.uint64(40)) + s.astype(np.uint64))
        ok = use[who]
        out.append((mix(total[ok] + salt(who[ok], which[ok])), who[ok], np.full(ok.sum(), step)))
        dels = use[owner] & (deletions[owner] > 0)
        if dels.any():
            run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(h)]))
            rest = (total[run] - value)[dels]
            out.append((mix(rest + salt(owner[dels], seg[dels])), owner[dels], np.full(len(rest), step)))
        # Empty segments: always next to deletions; next to exact segments only where they alone could make the agreement.
        empties = m - np.bincount(who, minlength=len(n))
        left[:, step] = np.where(deletions > 0, 0, np.maximum(spare - empties, 0))
        for i in np.flatnonzero(use & (empties > 0) & ((deletions > 0) | (empties > spare))):
            free = np.setdiff1d(np.arange(m[i]), which[who == i])
            w = np.full(len(free), i)
            out.append((mix(salt(w, free)), w, np.full(len(free), step)))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), left


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, node: the identity of its set, null when empty; and same: the hash of the text, equal for equal texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, bounds in shingle_sets(b.column(1), SIZE):
                n, ids = set_ids(h, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids.view(np.int64), pa.int64(), mask=n == 0), b.column(2).slice(lo, hi - lo)], ["id", "n_shingles", "node", "same"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("same", T.LongType())])
    plain = F.col(text).cast("string")
    return docs.select(key, plain.alias("text"), F.xxhash64(plain).alias("same")).mapInArrow(run, schema)


def shared_segments(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """sig, node, n, step, spare, freq for the segment contents of two nodes or more. Signatures travel packed, by bucket,
    and a task sends those of a node once, however many copies of it there are (of the last SEEN nodes or so)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, h, bounds in shingle_sets(b.column(0), SIZE):
                n, ids = set_ids(h, bounds)
                fresh = [i for i, x in enumerate(ids.tolist()) if n[i] and not (x in seen or seen.add(x))]
                if len(seen) > SEEN:
                    seen.clear()
                h, n, ids = h[ranges(bounds[:-1][fresh], n[fresh])], n[fresh], ids[fresh]
                bounds = np.r_[0, np.cumsum(n)]
                sig, who, step, left = signatures(h, bounds)
                sizes = np.column_stack((n.astype(np.uint32), left))
                bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                sig, who, step, bucket = sig[order], who[order], step[order], bucket[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(sig) else np.zeros(1, np.int64)
                rows = []
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    doc, local = np.unique(who[i:j], return_inverse=True)
                    rows.append((int(bucket[i]), sig[i:j].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), (local * 2 + step[i:j]).astype(np.uint32 if len(doc) > 30_000 else np.uint16).tobytes(), ids[doc].tobytes(), sizes[doc].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "sigs", "refs", "ids", "sizes"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, node, n, step, spare = [], [], [], [], []
        for s, r, i, k in zip(pdf["sigs"], pdf["refs"], pdf["ids"], pdf["sizes"], strict=True):
            ids, sizes = np.frombuffer(i, np.uint64), np.frombuffer(k, np.uint32).reshape(-1, 3)
            raw = np.zeros((len(s) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            ref = np.frombuffer(r, np.uint32 if len(ids) > 30_000 else np.uint16).astype(np.int64)
            sig.append(raw.view(np.uint64).ravel())
            node.append(ids[ref >> 1])
            n.append(sizes[ref >> 1, 0])
            spare.append(sizes[ref >> 1, 1 + (ref & 1)])
            step.append((ref & 1).astype(np.uint8))
        sig, node, n, step, spare = (np.concatenate(x) for x in (sig, node, n, step, spare))
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        order = order[np.r_[same, False] | np.r_[False, same]]
        order = order[np.lexsort((node[order], sig[order]))]
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, order = sig[new], node[new], order[new]
        _, back, freq = np.unique(sig, return_inverse=True, return_counts=True)
        freq = freq[back]
        ok = freq > 1
        sig = sig | mix(np.array([pdf["bucket"].iloc[0]], np.uint64)) << np.uint64(48)  # told apart by bucket, or, rarely, only verified in vain
        return pd.DataFrame({"sig": sig[ok].astype(np.uint64).view(np.int64), "node": node[ok].view(np.int64), "n": n[order[ok]].astype(np.int64), "step": step[order[ok]].astype(np.int32), "spare": spare[order[ok]].astype(np.int64), "freq": freq[ok].astype(np.int64)})

    packed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pack, "bucket int, sigs binary, refs binary, ids binary, sizes binary")
    return packed.groupBy("bucket").applyInPandas(meet, "sig long, node long, n long, step int, spare long, freq long")


def pass_over(hits: DataFrame) -> DataFrame:
    """The hits that can matter. Linked sets agree in more segments than either may spare: a set with fewer hits in a
    band has no partner there, and one with few frequent hits is still met in another segment without those."""
    each = hits.groupBy("node", "step").agg(F.count("*").alias("_k"), F.count_if(F.col("freq") > FREQUENT).alias("_often"), F.min("spare").alias("_spare")).filter("_k > _spare")
    kept = hits.join(each, ["node", "step"]).filter((F.col("freq") <= FREQUENT) | (F.col("_often") > F.col("_spare")))
    return kept.select("sig", "node", "n", F.col("_k").alias("w"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, compared on their whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(512, b.num_rows))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                left = part.column(2).dictionary_encode()
                k = len(left.dictionary)
                both = pa.concat_arrays([left.dictionary.cast(pa.large_string()), part.column(3).cast(pa.large_string())])
                sets = [h[bounds[i] : bounds[i + 1]] for lo, hi, h, bounds in shingle_sets(both, SIZE) for i in range(hi - lo)]
                ok = []
                for i, j in enumerate(left.indices.to_numpy()):
                    x, y = sets[j], sets[k + i]
                    z = np.concatenate((x, y))
                    z.sort()
                    inter = int((z[1:] == z[:-1]).sum())
                    ok.append(100 * inter >= 80 * (len(x) + len(y) - inter))
                yield part.filter(pa.array(ok)).select(["a", "b"])

    t = texts.select("node", "text")
    both = pairs.join(t.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(t.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, described: DataFrame, text: str) -> DataFrame:
    """Verified links (a, b) between nodes, enough for the components of all links."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    buckets = int(min(1 << 22, max(8, size // MEET_BYTES)))
    hits = written(pass_over(written(shared_segments(docs, text, buckets), "segments")), "hits")
    nodes = hits.select("node").distinct()
    # A node's text is found by its own hash: ids may be null, and rows of one id may differ in text.
    chosen = written(described.join(nodes, "node").groupBy("node").agg(F.min("same").alias("same")), "chosen")
    if chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    plain = F.col(text).cast("string")
    texts = written(docs.select(plain.alias("text"), F.xxhash64(plain).alias("same")).join(chosen, "same").select("node", "text").dropDuplicates(["node"]), "texts")
    # Each segment's pivot is the node with most hits (w), which in a group of copies is one near the middle.
    pivot = hits.groupBy("sig").agg(F.max(F.struct("w", "node", "n")).alias("p"))
    star = hits.join(pivot, "sig").select("node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")).filter("node <> pivot")
    pairs = written(star.groupBy("pivot", "node").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("pn").alias("pn")), "pairs")
    best = pairs.filter("5 * least(n, pn) >= 4 * greatest(n, pn)").groupBy("node").agg(F.max(F.struct("k", "pivot")).alias("p"))
    first = written(verify(best.select(F.col("p.pivot").alias("a"), F.col("node").alias("b")), texts), "first")
    return first.unionByName(across(pairs, components(first), texts))


def across(pairs: DataFrame, label: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between nodes that share a pivot and are in different components, one for each two components at most.

    The nodes of a pivot are dealt into blocks of about BLOCK shingles, and each two blocks of a pivot are compared by a
    product of their incidence matrices: no pairs are made, only links come out. Pivots of one component are left out.
    """
    members = pairs.select("pivot", "node", "n").unionByName(pairs.groupBy("pivot").agg(F.first("pn").alias("n")).select("pivot", F.col("pivot").alias("node"), "n"))
    named = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("size"), F.count("*").alias("sets")).filter("lo <> hi")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALT))  # a pivot's nodes may be many
    some = named.withColumn("salt", salt).join(mixed.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt"), F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks")), ["pivot", "salt"])
    dealt = some.join(texts.select("node", "text"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    packed = written(dealt.groupBy("pivot", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "label", "text")).alias("sets")), "blocks")
    left = packed.select("pivot", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), F.col("sets").alias("x"))
    right = packed.select("pivot", F.col("block").alias("j"), F.col("sets").alias("y"))

    def compare(x: pa.Array, y: pa.Array) -> Iterator[tuple[int, int]]:
        kinds = [(c.field("node").to_numpy(), c.field("label").to_numpy(), [h[b[i] : b[i + 1]] for lo, hi, h, b in shingle_sets(c.field("text"), SIZE) for i in range(hi - lo)]) for c in (x, y)]
        (nx, lx, sx), (ny, ly, sy) = kinds
        common = np.intersect1d(np.concatenate(sx), np.concatenate(sy))
        if not len(common):
            return
        places = []
        for sets in (sx, sy):
            flat, whose = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            ok = common[at] == flat
            order = np.argsort(at[ok], kind="stable")
            places.append((whose[ok][order], at[ok][order], len(sets)))
        inter, step = np.zeros((len(sx), len(sy)), np.float32), max(1, CELLS // (len(sx) + len(sy)))
        for begin in range(0, len(common), step):  # so many columns of the incidence matrices at a time
            parts = []
            for whose, at, n in places:
                i, j = np.searchsorted(at, [begin, begin + step])
                m = np.zeros((n, min(step, len(common) - begin)), np.float32)
                m[whose[i:j], at[i:j] - begin] = 1
                parts.append(m)
            inter += parts[0] @ parts[1].T
        inter = np.rint(inter).astype(np.int64)
        size = np.array([len(t) for t in sx])[:, None] + np.array([len(t) for t in sy])[None, :]
        i, j = np.nonzero((100 * inter >= 80 * (size - inter)) & (lx[:, None] != ly[None, :]))
        _, one = np.unique(np.column_stack((lx[i], ly[j])), axis=0, return_index=True)
        yield from ((int(nx[i[k]]), int(ny[j[k]])) for k in one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pair for r in range(b.num_rows) for pair in compare(b.column(0).slice(r, 1).flatten(), b.column(1).slice(r, 1).flatten())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return left.join(right, ["pivot", "j"]).select("x", "y").mapInArrow(run, "a long, b long")


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, same (the hash of the text), n_shingles, component_id for every row; component_id is the id of an empty text."""
    described = written(describe(docs, key, text), "described")
    label = components(links(docs, described, text))
    least = described.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    named = least.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of = named.join(smallest, "label").select("node", "component_id")
    out = described.join(of, "node", "left")
    return out.select("id", "same", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for every row."""
    return classed(docs, key, text).select(F.col("id").alias(key), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents but for those whose component has a smaller id, or for a null id any; rows of the component's id all stay."""
    gone = classed(docs, key, text).filter(F.col("component_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_gone"), "same").distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["same"]), "left_anti")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


CLASSES_SQL = r"""
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
c AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY x)"""
OP7_SQL = f"""
WITH RECURSIVE {CLASSES_SQL.format(docs="documents")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""
