"""Alignment of two tokenizers by where their tokens end, with id-striped dense count matrices.

A text, with a space before it, is coded by A (byte-level BPE) and B (pieces); where tokens of both end at one byte, they
are linked. Both code a text unit by unit (a space that stands behind no white space begins one), so the tokens, links and
groups of a unit are worked out once by a worker and remembered.

coded() writes one table: for each slice of documents their own figures, and the slice's links, parted by stripe: the id
of the counted side modulo STRIPES. counts() adds up a task's links by pair, brings them to their stripe, and adds them
with np.add.at to a dense block, a row for an id of the stripe; row maxima give each id's best. aligned() sends each
stripe's links to where its block is (a stripe of many links is salted, its block repeated), scores them there, and adds
the scores up by slice. What travels is packed by slice and stripe; nothing but the sizes of the stripes meets the driver.

Defined results: a null or empty text, and one that a tokenizer doesn't give back as it was, has no tokens: zeros and an
empty groups text; strings of special tokens are plain text; repeated rows and null ids each get their own figures, and all
count; texts of any length are coded whole; an empty table gives an empty one. Columns but the key aren't kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.shared import written
from tessella.llm.text_arrays import numbers, planes, ranges

STRIPES = 128
#: Characters and rows of a slice, characters that are coded in one call, units that a worker remembers.
SLICE, ROWS, CALL, MEMO = 2 << 20, 20_000, 1 << 15, 250_000
#: Pairs that a task holds before it adds them up, and bytes of a stripe's links that go to one task, about.
HELD, SALT_BYTES = 1 << 20, 64 << 20
_BEGIN, _ODD = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_KEYS = ("n_a", "n_b", "n_groups")


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """The units of a text, each without the space that it begins with."""
    if not _ODD.search(" " + text):
        return text.split(" ")
    first, *rest = _BEGIN.split(" " + text)
    return [first[1:], *rest]


class _Numbered(dict):
    """Numbers of units, given as they are first asked for; new has those that aren't coded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Coder:
    """Both tokenizers and what is known of units. It travels as the two files' bytes and is built where it is first used."""

    def __init__(self, a: bytes, b: bytes):
        self.files = (a, b)

    def __getstate__(self):
        return {"files": self.files}

    def __getattr__(self, name: str):
        if name not in ("a", "b", "raw", "said", "numbered"):
            raise AttributeError(name)
        self._build()
        return self.__dict__[name]

    def _build(self) -> None:
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(self.files[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=self.files[1])
        self.a.encode_special_tokens = True
        byte, names = byte_of_character(), {i: t for t, i in self.a.get_vocab().items()}
        a_raw = [bytes(byte[c] for c in names.get(i, "")) if all(c in byte for c in names.get(i, "")) else names[i].encode() for i in range(max(names) + 1)]
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space behind another character, so texts can't be cut into units")
        b_raw = [bytes.fromhex(p[3:5]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
        self.raw = (a_raw, b_raw)
        self.size = tuple(np.array([len(x) for x in r], np.int64) for r in self.raw)
        # What a token adds to the groups text: its id, and what follows, by whether it ends its side of the group.
        self.said = [b"%d," % i for i in range(len(a_raw))] + [b"%d|" % i for i in range(len(a_raw))] + [b"%d," % i for i in ids] + [b"%d;" % i for i in ids]
        self.said_size = np.array([len(x) for x in self.said], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbered, self.texts = _Numbered(), []
        self.counts, self.valid = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.pairs, self.pair_at = np.zeros((0, 2), np.int64), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        u = units(text)
        return np.fromiter(map(self.numbered.__getitem__, u), np.int64, len(u))

    def learn(self) -> None:
        """Codes the new units, many in a call; those that end in white space by themselves."""
        new, self.numbered.new = self.numbered.new, []
        calls: list[list[int]] = []
        held, size = [], 0
        for n, u in enumerate(new):
            if not u or u[-1].isspace():
                calls.append([n])
                continue
            held.append(n)
            size += len(u) + 1
            if size >= CALL:
                calls.append(held)
                held, size = [], 0
        if held:
            calls.append(held)
        done = []
        while calls:
            known = self._coded([[new[n] for n in c] for c in calls])
            done += [(np.array(c), *k) for c, k in zip(calls, known, strict=True) if k is not None]
            calls = [[n] for c, k in zip(calls, known, strict=True) if k is None for n in c]
        if done:
            self._keep(done)

    def _coded(self, calls: list[list[str]]) -> list:
        """For each call the tokens of both sides (none if they don't give it back) and where its units end; None for several units that can't be told apart."""
        whole = ["x" + "".join(" " + u for u in c) for c in calls]  # a unit before, so that none is the first
        a_ids = [np.array(e.ids[1:], np.int64) for e in self.a.encode_batch(whole, add_special_tokens=False)]
        b_ids = [np.array(x[1:], np.int64) for x in self.b.encode(whole, num_threads=1)]
        out = []
        for c, text, a, b in zip(calls, whole, a_ids, b_ids, strict=True):
            raw = text[1:].encode()
            ends = np.cumsum([len(u.encode()) + 1 for u in c])
            fits = all(b"".join(map(r.__getitem__, ids.tolist())) == raw and (len(c) == 1 or np.isin(ends, np.cumsum(size[ids])).all()) for r, size, ids in zip(self.raw, self.size, (a, b), strict=True))
            out.append((a, b, ends) if fits else (a[:0], b[:0], np.array([1])) if len(c) == 1 else None)
        return out

    def _keep(self, done: list[tuple]) -> None:
        """Remembers units: done has the numbers of some, their tokens of both sides, and where they end."""
        base, sides, ends = 0, ([], []), []
        for _, a, b, end in done:
            for side, ids in enumerate((a, b)):
                sides[side].append(np.stack((ids, base + np.cumsum(self.size[side][ids]))))
            ends.append(base + end)
            base += int(end[-1])
        (a, a_end), (b, b_end), ends = np.concatenate(sides[0], 1), np.concatenate(sides[1], 1), np.concatenate(ends)
        a_last, b_last = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)  # the last of its side in a group
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        token = np.r_[a + len(self.raw[0]) * a_last, b + 2 * len(self.raw[0]) + len(self.raw[1]) * b_last]
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
        blob, told = b"".join(map(self.said.__getitem__, token[order].tolist())), np.r_[0, np.cumsum(self.said_size[token[order]])]
        links = np.flatnonzero(a_last)
        tokens = np.r_[0, np.cumsum(np.bincount(a_group, minlength=len(links)) + np.bincount(b_group, minlength=len(links)))]
        cut = np.searchsorted(a_end[links], ends, "right")  # groups up to the end of each unit
        text_at, n_links = told[tokens[cut]], np.diff(cut, prepend=0)
        counts = np.stack([np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_end, b_end)] + [n_links], 1)
        to = np.argsort(np.concatenate([n for n, *_ in done]))  # units come in the order of the calls
        text = [blob[i:j] for i, j in zip([0, *text_at[:-1].tolist()], text_at.tolist(), strict=True)]
        self.texts += [text[i] for i in to.tolist()]
        self.counts, self.valid = np.concatenate((self.counts, counts[to])), np.r_[self.valid, counts[to, 0] > 0]
        pairs = np.stack((a[links], b[np.flatnonzero(b_last)]), 1)[ranges((cut - n_links)[to], n_links[to])]
        self.pairs, self.pair_at = np.concatenate((self.pairs, pairs)), np.r_[self.pair_at, self.pair_at[-1] + np.cumsum(n_links[to])]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right"))))
        yield lo, hi
        lo = hi


def _slice(texts: list[str | None], coder: Coder, side: int, keep: bool) -> tuple[list, Iterator[tuple]]:
    """The documents' figures (n_a, n_b, n_groups, hash and, if kept, text of the groups), and (stripe, pairs, links) of the slice."""
    if len(coder.numbered) > MEMO:
        coder.forget()
    each = [coder.numbers(t) if t else np.zeros(0, np.int64) for t in texts]
    coder.learn()
    each = [x if coder.valid[x].all() else x[:0] for x in each]
    size = np.array([len(x) for x in each])
    unit, owner = np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.arange(len(each)), size)
    sums = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(coder.counts[unit], 0)))
    figures = np.diff(sums[np.r_[0, np.cumsum(size)]], axis=0)
    said = [b"".join(map(coder.texts.__getitem__, x.tolist()))[:-1] if len(x) else None for x in each]
    hashes = [hashlib.sha256(x).hexdigest() if x is not None else "" for x in said]
    doc_unit, times = np.unique(owner << 32 | unit, return_counts=True)
    doc, unit = doc_unit >> 32, doc_unit & 0xFFFFFFFF
    n = coder.counts[unit, 2]
    pair = coder.pairs[ranges(coder.pair_at[unit], n)]
    own, other = pair[:, side], pair[:, 1 - side]
    code, inverse = np.unique((own % STRIPES) << 48 | (own // STRIPES) << 32 | other, return_inverse=True)
    link, at = np.unique(inverse * len(each) + np.repeat(doc, n), return_inverse=True)
    weight = np.bincount(at, np.repeat(times, n), len(link)).astype(np.int64)
    pair_of, doc = np.divmod(link, max(1, len(each)))
    first = np.searchsorted(pair_of, np.arange(len(code) + 1))
    total = np.diff(np.r_[0, np.cumsum(weight)][first])

    def parts() -> Iterator[tuple]:
        cut = np.searchsorted(code >> 48, np.arange(STRIPES + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            x, y = slice(cut[s], cut[s + 1]), slice(first[cut[s]], first[cut[s + 1]])
            yield s, planes(np.concatenate((code[x] >> 32 & 0xFFFF, code[x] & 0xFFFFFFFF, total[x], np.diff(first[cut[s] : cut[s + 1] + 1])))), planes(np.concatenate((doc[y], weight[y])))

    return [*figures.T, hashes, [None if x is None else x.decode() for x in said] if keep else None], parts()


def coded(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, side: int = 1, keep: bool = False) -> DataFrame:
    """The written table: a row a slice with stripe -1 and docs, and a row for each of its stripes with pairs, links and size."""
    spark = docs.sparkSession
    paths = [x or y for x, y in zip((a, b), default_models(), strict=True)] if not (a and b) else [a, b]
    held = spark.sparkContext.broadcast(Coder(*[open(p, "rb").read() for p in paths]))  # two files of a tokenizer, some MB
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    doc = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in _KEYS], T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType())])
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("stripe", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("pairs", T.BinaryType()), T.StructField("links", T.BinaryType()), T.StructField("docs", T.ArrayType(doc))])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = held.value, TaskContext.get().partitionId() << 32
        fields = [pa.field("key", arrow), *[pa.field(c, pa.int64()) for c in _KEYS], pa.field("groups_sha256", pa.string()), pa.field("groups", pa.string())]
        for batch in batches:
            for lo, hi in _parts(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(lo, hi - lo)
                number += 1
                (n_a, n_b, n_groups, hashes, said), links = _slice(part.column(1).to_pylist(), coder, side, keep)
                columns = [part.column(0), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(hashes, pa.string()), pa.array(said, pa.string()) if keep else pa.nulls(hi - lo, pa.string())]
                own = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([0]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), own], schema.names)
                got = list(links)
                if got:
                    stripe, pairs, links = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(got)), pa.array(stripe, pa.int32()), pa.array([len(x) + len(y) for x, y in zip(pairs, links, strict=True)], pa.int64()), pa.array(pairs, pa.binary()), pa.array(links, pa.binary()), pa.nulls(len(got), own.type)], schema.names)

    return written(rows.mapInArrow(run, schema), "coded")


def _added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    out = np.zeros(len(code), np.int64)
    np.add.at(out, at, n)
    return code, out


def _presum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs, added up: stripe, and a row of codes above a row of counts."""
    codes, counts, size = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        code, n = _added(np.concatenate(codes), np.concatenate(counts))
        cut = np.searchsorted(code >> 48, np.arange(STRIPES + 1))
        has = np.flatnonzero(np.diff(cut)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array([np.stack((code[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]])).tobytes() for s in has], pa.binary())], ["stripe", "pairs"])

    for b in batches:
        for stripe, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own, other, n, _ = numbers(blob).reshape(4, -1)
            codes.append(stripe << 48 | own << 32 | other)
            counts.append(n)
            size += len(n)
        if size > HELD:
            code, n = _added(np.concatenate(codes), np.concatenate(counts))
            codes, counts, size = [code], [n], 0
            if len(code) > HELD:  # more different pairs than a task holds
                yield from out()
                codes, counts = [], []
    if codes:
        yield from out()


def counts(table: DataFrame) -> DataFrame:
    """stripe and block: own id / STRIPES, other id, count and whether it is the own id's best, four rows of numbers; a row a stripe."""
    parts = table.filter("stripe >= 0").select("stripe", "pairs").mapInArrow(_presum, "stripe int, pairs binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, np.zeros((0, 0), np.int64)

        def out() -> pa.RecordBatch:
            best = block.max(1)
            own, other = np.nonzero(block)
            n = block[own, other]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.stack((own, other, n, n == best[own])).astype(np.int64).tobytes()], pa.binary())], ["stripe", "block"])

        for b in batches:
            for stripe, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if stripe != now:
                    if now is not None:
                        yield out()
                    now, block = stripe, np.zeros((0, 0), np.int64)
                code, n = np.frombuffer(blob, np.int64).reshape(2, -1)
                own, other = code >> 32 & 0xFFFF, code & 0xFFFFFFFF
                need = (int(own.max(initial=-1)) + 1, int(other.max(initial=-1)) + 1)
                if need[0] > block.shape[0] or need[1] > block.shape[1]:
                    grown = np.zeros((max(need[0], block.shape[0]), max(need[1], block.shape[1] + block.shape[1] // 4)), np.int64)
                    grown[: block.shape[0], : block.shape[1]] = block
                    block = grown
                np.add.at(block, (own, other), n)
        if now is not None:
            yield out()

    return written(parts.repartition(STRIPES // 4, "stripe").sortWithinPartitions("stripe").mapInArrow(add, "stripe int, block binary"), "stripes")


def pair_counts(stripes: DataFrame) -> DataFrame:
    """own, other, count and best of all pairs that are linked, from counts()."""
    schema = "own long, other long, count long, best boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, other, n, best = np.frombuffer(blob, np.int64).reshape(4, -1)
                yield pa.RecordBatch.from_arrays([pa.array(own * STRIPES + stripe), pa.array(other), pa.array(n), pa.array(best > 0)], ["own", "other", "count", "best"])

    return stripes.mapInArrow(run, schema)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of links by slice and document: docs, best and sums. A stripe's block comes before its links."""
    block, best, met = np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        slices, scores = [], []
        for number, pairs, links in zip(*(b.column(c).to_pylist() for c in ("slice", "pairs", "links")), strict=True):
            if number < 0:
                own, other, n, _ = np.frombuffer(pairs, np.int64).reshape(4, -1)
                met, column = np.unique(other, return_inverse=True)
                block = np.zeros((int(own.max()) + 1, len(met)), np.int64)
                block[own, column] = n
                best = block.max(1)
                continue
            own, other, _, size = numbers(pairs).reshape(4, -1)
            doc, weight = numbers(links).reshape(2, -1)
            n = block[own, np.searchsorted(met, other)]
            top = np.repeat(n == best[own], size) * weight
            docs, at = np.unique(doc, return_inverse=True)
            out = np.zeros((2, len(docs)), np.int64)
            np.add.at(out[0], at, top)
            np.add.at(out[1], at, np.repeat(n, size) * weight)
            slices.append(number)
            scores.append(np.concatenate((docs[None], out)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(scores, pa.binary())], ["slice", "scores"])


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, side: int = 1, keep: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their id on this side: 1 for B, 0 for A),
    count_sum and groups_sha256 of each document, and groups where they are kept."""
    table = coded(docs, key, text, a, b, side, keep)
    stripes = counts(table)
    links = table.filter("stripe >= 0")
    salts = links.groupBy("stripe").agg(F.ceil(F.sum("size") / SALT_BYTES).cast("int").alias("salts"))  # STRIPES rows
    dealt = links.join(F.broadcast(salts), "stripe").select("stripe", F.pmod(F.xxhash64("slice"), "salts").cast("int").alias("salt"), "slice", "pairs", "links")
    blocks = stripes.join(F.broadcast(salts), "stripe").select("stripe", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(-1).cast("long").alias("slice"), F.col("block").alias("pairs"), F.lit(None).cast("binary").alias("links"))
    scored = dealt.unionByName(blocks).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "slice").mapInArrow(_score, "slice long, scores binary")
    own = table.filter("stripe < 0").select("slice", F.lit(None).cast("binary").alias("scores"), "docs")
    both = own.unionByName(scored.withColumn("docs", F.lit(None).cast(own.schema["docs"].dataType)))
    kind = own.schema["docs"].dataType.elementType
    fields = [*[f for f in kind if f.name != "groups"], *[T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")], *[f for f in kind if keep and f.name == "groups"]]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = None, np.zeros((2, 0), np.int64)

        def out() -> pa.RecordBatch:
            of = dict(zip(kind.names, rows.flatten(), strict=True))
            of |= {"n_links": of["n_groups"], "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            return pa.RecordBatch.from_arrays([of[f.name] for f in fields], [f.name for f in fields])

        for batch in batches:
            for n in range(batch.num_rows):
                if batch.column(2)[n].is_valid:  # a slice's documents come before its scores
                    if rows is not None:
                        yield out()
                    rows = batch.column(2).slice(n, 1).flatten()
                    sums = np.zeros((2, len(rows)), np.int64)
                else:
                    docs, best, count = np.frombuffer(batch.column(1)[n].as_py(), np.int64).reshape(3, -1)
                    sums[:, docs] += np.stack((best, count))
        if rows is not None:
            yield out()

    return both.repartition("slice").sortWithinPartitions("slice", F.col("scores").isNotNull()).mapInArrow(total, T.StructType(fields))


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    out = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
