"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end. What is learned comes from the training texts alone. The contexts' counts
leave a training text's own occurrence of an event out, but a word's class, its share of it and whether it is spelled go
by counts that include it: so training texts score higher than held-out ones of the same kind, and only scores of one
side compare.
Each word is told by binary decisions, each predicted by several hashed contexts:

* is it the word that most often follows the last two words (asked where these were seen in training)? Contexts: how
  often and how surely that pair was followed so; the answers to the last three such questions; the last word's class.
* if not, the bits of its class (the magnitude of its count) and of a few bits of its hash. Contexts: the bits before,
  alone; with the last word; with the word before that. Within a class and hash, words share by their counts.
* a word with fewer than two training occurrences is class 0 and is spelled: the bits of its bytes, from the last one
  to three bytes, all bytes so far, and the last two bytes with the word before.

All predictions of a decision are stretched and mixed by weights gated by the decision's place. The weights are learned
online while a text is read, a block of decisions after the other. Every decision is a distribution and every word has
one code, so the scores of all texts sum to one at most.

Words travel to their counts by hash bucket, as do pairs of words to what follows them: each slice of documents sends
its distinct ones once, and both grow with the corpus. Broadcast are the context tables, whose size follows the corpus
up to 2^WORD_BITS slots, and a few sums. Scores don't depend on how the rows are dealt over partitions.

Defined results: a null or empty text is one end; a null id is crc32 of the empty string; rows of equal ids are scored
each; without training documents, known counts are zero and every bit costs one; a text of any length is read in
pieces, though its words are held at once; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.text_arrays import mix, slices, word_hashes, words

#: Words in a slice of documents; units in a step of reading; units between two changes of the weights.
SLICE_WORDS, STEP, BLOCK = 3 << 19, 1 << 16, 32
#: Events (distinct words, or pairs with what follows) that meet in one group, about.
GROUP = 1 << 20
#: Bytes of joined slices that a task of counting reads at least: each task sends its counts of all tables once.
COUNTED = 32 << 20
#: Slots of a table: at most for word contexts, always for spelling; entries of the exact tables.
WORD_BITS, SPELL_BITS, EXACT = 21, 18, 1024
CLASSES, HASH_BITS = 32, 4
TAG_BITS = 20
#: By kind of decision: its gates (the places of its bits), the weights of its contexts where a text begins, and the rate
#: at which they change while it is read.
KINDS = {"follow": (1, (0.6, 0.6, 0.6), 0.02), "word": (5 + HASH_BITS, (0.7, 0.15, 0.15), 0.02), "spell": (8, (0.3, 0.3, 0.3, 0.3, 0.3), 0.004)}
_PART = 1 << 14
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def held_out(key: str) -> bool:
    return zlib.crc32(key.encode()) % 7 == 2


def packed(x: np.ndarray) -> bytes:
    """The bytes of x by place in the number, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(x: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x[8:], n, codec="zstd", asbytes=True), np.uint8).reshape(size, -1).T).view(kind).ravel()


def spelled(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words at starts, each followed by a space; sizes count the space."""
    at = np.cumsum(sizes)
    out = np.full(int(at[-1]) if len(at) else 0, 32, np.uint8)
    inside = np.repeat(starts - (at - sizes), sizes) + np.arange(len(out))
    real = np.ones(len(out), bool)
    real[at - 1] = False
    out[real] = data[inside[real]]
    return out


# --- Slices of documents -------------------------------------------------------------------------------------------


def gather(docs: DataFrame) -> DataFrame:
    """Slices of documents: ids, words a document, bytes a document, the distinct words, and all words as their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, n = [], [], 0

        def slice_row() -> pa.RecordBatch:
            hashes = np.concatenate([p[0] for p in parts])
            _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            begin = np.cumsum([0] + [len(p[0]) for p in parts])
            refs = np.concatenate([back[begin[i] + p[2]] for i, p in enumerate(parts)])
            order = np.argsort(-np.bincount(refs, minlength=len(first)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            data = np.concatenate([p[1] for p in parts])
            ends = np.flatnonzero(data == 32)
            starts, pick = np.r_[0, ends[:-1] + 1], first[order]
            blob = spelled(data, starts[pick], (ends - starts)[pick] + 1) if len(pick) else data
            row = [number, ids, *(packed(np.concatenate([p[i] for p in parts])) for i in (3, 4)), packed(blob), packed(rank[refs].astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4), strict=True)], ["slice", "ids", "lengths", "sizes", "words", "refs"])

        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi, data, offsets in slices(b.column(1)):
                starts, ends, owner = words(data, offsets)
                uniq, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                ids += keys[lo:hi]
                parts.append((uniq, spelled(data, starts[first], (ends - starts)[first] + 1), back, np.bincount(owner, minlength=hi - lo).astype(np.uint64), np.diff(offsets).astype(np.uint64)))
                n += len(starts)
                if n >= SLICE_WORDS:
                    yield slice_row()
                    number, ids, parts, n = number + 1, [], [], 0
        if ids:
            yield slice_row()

    return docs.mapInArrow(run, "slice long, ids array<string>, lengths binary, sizes binary, words binary, refs binary")


class Slice:
    """A slice's tokens (the words and ends of its documents, in order) as numbers of its distinct words; 0 is the end."""

    def __init__(self, row):
        self.ids, self.number = [None if k is None else str(k) for k in row.ids], int(row.slice)
        self.lengths = unpacked(row.lengths, np.uint64).astype(np.int64) + 1
        self.data = np.r_[np.uint8(10), np.uint8(32), unpacked(row.words, np.uint8)]
        ends = np.flatnonzero(self.data == 32)
        self.starts = np.r_[0, ends[:-1] + 1]
        self.word_sizes = ends - self.starts + 1
        self.hashes = word_hashes(self.data, self.starts, ends)
        last = np.cumsum(self.lengths) - 1
        self.tokens = np.zeros(int(last[-1]) + 1, np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[last] = False
        self.tokens[inner] = unpacked(row.refs, np.uint32) + np.uint32(1)
        self.owner = np.repeat(np.arange(len(last), dtype=np.int32), self.lengths)
        self.begin = last - self.lengths + 1
        self.learn = np.array([not held_out(k or "") for k in self.ids])
        self.train = self.learn[self.owner]

    @cached_property
    def before(self) -> np.ndarray:
        """The hash of the word before each token in its document, else 0."""
        out = np.r_[np.uint64(0), self.hashes[self.tokens[:-1]]]
        out[self.begin] = 0
        return out

    @cached_property
    def second(self) -> np.ndarray:
        out = np.r_[np.uint64(0), self.before[:-1]]
        out[self.begin] = 0
        return out

    def follows(self) -> np.ndarray:
        """By token: 43 bits of the last two words' hash, the tag of the word, and 1 for a training text."""
        out, shift = np.empty(len(self.tokens), np.uint64), np.uint64(TAG_BITS + 1)
        for at in range(0, len(out), STEP):
            part = slice(at, at + STEP)
            pair = mix(self.before[part] * _A + mix(self.second[part] ^ _C) * _B)
            out[part] = pair >> shift << shift | self.hashes[self.tokens[part]] >> np.uint64(64 - TAG_BITS) << np.uint64(1) | self.train[part].astype(np.uint64)
        return out


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits: sorted numbers come bucket by bucket."""
    return ((x >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)


def _messages(slices_: DataFrame, buckets: int, distinct: Callable) -> DataFrame:
    """Each slice's sorted distinct events and their numbers, one row a bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                s = Slice(row)
                x, n = distinct(s)
                bucket = bucket_of(x, buckets)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                yield pd.DataFrame({"bucket": bucket[cut[:-1]], "slice": s.number, "events": [packed(np.diff(x[i:j], prepend=np.uint64(0))) for i, j in zip(cut[:-1], cut[1:], strict=True)], "counts": [packed(n[i:j].astype(np.uint64)) for i, j in zip(cut[:-1], cut[1:], strict=True)]})

    return slices_.mapInPandas(run, "bucket int, slice long, events binary, counts binary")


def _events(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All events of a bucket, their numbers, and where the next slice's begin."""
    each = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in pdf["events"]]
    return np.concatenate(each), np.concatenate([unpacked(x, np.uint64) for x in pdf["counts"]]), np.cumsum([len(x) for x in each])[:-1]


def classes(count: np.ndarray) -> np.ndarray:
    """0 for words to spell, else 1 and up by the magnitude of the count."""
    return np.where(count < 2, 0, np.minimum(CLASSES - 1, 1 + np.floor(np.log2(np.maximum(count.astype(np.float64) - 1, 1))).astype(np.int64)))


def cells(count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return classes(count) << HASH_BITS | (hashes >> np.uint64(20) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def word_counts(gathered: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket its words' training counts and their shares of their tags' counts; a row of sums a bucket (slice -1).

    A share is the upper half of a 32-bit float, so it is rounded down, by less than one in a hundred.
    """
    def distinct(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(s.hashes)
        return s.hashes[order], np.bincount(s.tokens, weights=s.train, minlength=len(s.hashes))[order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, cut = _events(pdf)
        uniq, back = np.unique(x, return_inverse=True)
        count = np.bincount(back, weights=n, minlength=len(uniq)).astype(np.uint64)
        _, tag = np.unique(uniq >> np.uint64(64 - TAG_BITS), return_inverse=True)
        share = count / np.maximum(np.bincount(tag, weights=count), 1)[tag]
        sums = [int(count.sum()), int((count > 0).sum()), *np.bincount(cells(count, uniq), weights=count, minlength=CLASSES << HASH_BITS).astype(np.int64)]
        each = lambda v: [None, *(packed(p) for p in np.split(v[back], cut))]
        return pd.DataFrame({"bucket": int(pdf["bucket"].iloc[0]), "slice": [-1, *pdf["slice"]], "counts": each(count), "shares": each((share.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)), "sums": [[int(v) for v in sums]] + [None] * len(pdf)})

    return _messages(gathered, buckets, distinct).groupBy("bucket").applyInPandas(run, "bucket int, slice long, counts binary, shares binary, sums array<long>")


def state_of(n: np.ndarray, top: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """What a pair of words tells: 0 when it was not seen, else 1 + 2 * (how often seen, how surely followed so) + whether so."""
    often = np.searchsorted([2, 3, 5, 9], n, "right")
    sure = (top * 2 >= n).astype(np.int64) + (top * 5 >= n * 4) + (top == n)
    return np.where(n > 0, 1 + 2 * (often * 4 + sure) + hit, 0).astype(np.uint8)


def followers(gathered: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket the states of its distinct pairs with what follows, own occurrences left out."""
    def distinct(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(s.follows(), return_counts=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, cut = _events(pdf)
        order = np.argsort(x, kind="stable")
        sx = x[order]
        step = lambda v: np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        each = step(sx >> np.uint64(1))  # (pair, word)
        c = np.add.reduceat(np.where(sx & np.uint64(1), n[order], 0).astype(np.int64), each)
        words_ = sx[each] >> np.uint64(1)
        pair = words_ >> np.uint64(TAG_BITS)
        at = step(pair)
        of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(pair)]))
        total = np.add.reduceat(c, at)
        best = np.lexsort((-c, of))  # by count, then by tag
        first = best[at]
        more = np.r_[at[1:], len(pair)] - at > 1
        second = np.where(more, best[np.minimum(at + 1, len(best) - 1)], first)
        c1, c2 = c[first], np.where(more, c[second], 0)
        i = np.arange(len(c))
        is_top = i == first[of]
        plain = state_of(total[of], c1[of], is_top)
        still = (c - 1 > c2[of]) | ((c - 1 == c2[of]) & (first < second)[of]) | (c2[of] == 0)
        own = state_of(total[of] - 1, np.where(is_top, np.where(still, c - 1, c2[of]), c1[of]), is_top & still)
        back = np.repeat(np.arange(len(each)), np.diff(np.r_[each, len(sx)]))
        out = np.empty(len(x), np.uint8)
        out[order] = np.where(sx & np.uint64(1), own[back], plain[back])
        return pd.DataFrame({"bucket": int(pdf["bucket"].iloc[0]), "slice": pdf["slice"].to_numpy(), "states": [packed(p) for p in np.split(out, cut)]})

    return _messages(gathered, buckets, distinct).groupBy("bucket").applyInPandas(run, "bucket int, slice long, states binary")


def joined(gathered: DataFrame, counted: DataFrame, followed: DataFrame) -> DataFrame:
    """The slices with counts and shares by word and the state by token."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in [*left.columns, "counts", "shares", "states"]})
        s = Slice(left.iloc[0])
        right = right.sort_values("bucket")
        by_word, by_pair = right[right["counts"].notna()], right[right["states"].notna()]
        order = np.argsort(s.hashes)
        count, share = np.empty(len(order), np.uint64), np.empty(len(order), np.uint16)
        count[order] = np.concatenate([unpacked(x, np.uint64) for x in by_word["counts"]])
        share[order] = np.concatenate([unpacked(x, np.uint16) for x in by_word["shares"]])
        _, back = np.unique(s.follows(), return_inverse=True)
        state = np.concatenate([unpacked(x, np.uint8) for x in by_pair["states"]])[back]
        return left.assign(counts=[packed(count)], shares=[packed(share)], states=[packed(state)])

    both = counted.filter("slice >= 0").select("bucket", "slice", "counts", "shares").unionByName(followed, allowMissingColumns=True)
    schema = "slice long, ids array<string>, lengths binary, sizes binary, words binary, refs binary, counts binary, shares binary, states binary"
    return gathered.groupBy("slice").cogroup(both.groupBy("slice")).applyInPandas(run, schema)


# --- Decisions and what predicts them --------------------------------------------------------------------------------


def _word_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By cell: the nodes of its bits, the bits, and which of them are told (a class of 0 tells no hash)."""
    cell = np.arange(CLASSES << HASH_BITS)[:, None]
    kind, low = cell >> HASH_BITS, cell & ((1 << HASH_BITS) - 1)
    a, b = np.arange(5), np.arange(HASH_BITS)
    nodes = np.hstack([(1 << a) | kind >> (5 - a), CLASSES + (kind << HASH_BITS) + ((1 << b) | low >> (HASH_BITS - b))])
    bits = np.hstack([kind >> (4 - a) & 1, low >> (HASH_BITS - 1 - b) & 1]).astype(bool)
    return nodes, bits, np.hstack([np.ones((len(cell), 5), bool), np.repeat(kind > 0, HASH_BITS, 1)])


NODES, BITS, TOLD = _word_code()
_NODE_HASH = NODES.astype(np.uint64) * _A
_BYTE_NODES = ((1 << np.arange(8)) | (np.arange(256)[:, None] >> (8 - np.arange(8)))).astype(np.uint64) * _A
_BYTE_BITS = (np.arange(256)[:, None] >> (7 - np.arange(8)) & 1).astype(bool)


def layout(bits: int) -> dict[str, tuple[int, int, int]]:
    """Where each group of tables lies in the one array of counts: start, tables, slots."""
    out, at = {}, 0
    for name, tables, slots in (("word", 2, 1 << bits), ("spell", 5, 1 << SPELL_BITS), ("exact", 4, EXACT)):
        out[name] = (at, tables, slots)
        at += 2 * tables * slots
    return out


def stretches() -> np.ndarray:
    """Stretched predictions by zeros + 256 * ones: as they are; with a zero left out; with a one left out."""
    one, zero = (v.astype(np.float64) for v in np.divmod(np.arange(1 << 16), 256))
    most = np.maximum(one, zero) == 255  # shrunken counts, where one occurrence is nothing
    at = lambda z, o: np.log((np.maximum(o, 0) + 0.4) / (np.maximum(z, 0) + 0.4))
    return np.concatenate([at(zero, one), at(zero - ~most, one), at(zero, one - ~most)]).astype(np.float32)


STRETCH = stretches()


def tables_of(flat: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """The tables of counts as pairs of bytes, those of exact contexts as stretched predictions."""
    part = {k: flat[at : at + 2 * t * n].reshape(t, n, 2).astype(np.float32) for k, (at, t, n) in layout(bits).items()}
    small = {k: np.ceil(part[k] / np.maximum(1, part[k].max(-1, keepdims=True) / 255)).astype(np.uint16) for k in ("word", "spell")}
    out = {k: v[..., 0] + (v[..., 1] << 8) for k, v in small.items()}
    return out | {"exact": np.log((part["exact"][..., 1] + np.float32(0.4)) / (part["exact"][..., 0] + np.float32(0.4)))}


class Decisions:
    """The decisions of a joined slice: of each kind the units, their documents, slots, bits, and which are told."""

    def __init__(self, row, bits: int):
        self.slice = s = Slice(row)
        self.bits = bits
        self.count = unpacked(row.counts, np.uint64)
        self.share = (unpacked(row.shares, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)
        self.state = unpacked(row.states, np.uint8)
        self.cell = cells(self.count, s.hashes)
        self.right = (self.state > 0) & (self.state & 1 == 0)  # the state counts from 1
        self.asked = np.flatnonzero(self.state)
        self.coded = np.flatnonzero(~self.right)
        self.spelt = self.coded[self.count[s.tokens[self.coded]] < 2]
        # The last three answers in the same document.
        right, owner = self.right[self.asked], s.owner[self.asked]
        self.past = np.zeros(len(right), np.int64)
        for k in (1, 2, 3):
            self.past[k:] |= (right[:-k] & (owner[k:] == owner[:-k])).astype(np.int64) << (k - 1)
        word = s.tokens[self.spelt]
        self.letters = spelled(s.data, s.starts[word], s.word_sizes[word])
        self.letter_of = np.repeat(np.arange(len(word)), s.word_sizes[word])

    def units(self, kind: str) -> np.ndarray:
        """How many units of a kind each document has."""
        token = {"follow": self.asked, "word": self.coded, "spell": self.spelt[self.letter_of]}[kind]
        return np.bincount(self.slice.owner[token], minlength=len(self.slice.lengths))

    def follow(self, lo: int, hi: int) -> tuple[list, np.ndarray, np.ndarray | None, np.ndarray | None]:
        at = self.asked[lo:hi]
        state = (self.state[at].astype(np.int64) - 1) >> 1
        last = np.where(at > 0, self.cell[self.slice.tokens[at - 1]] >> HASH_BITS, 0)
        last[self.slice.before[at] == 0] = 0
        slots = [("exact", 1, state[:, None]), ("exact", 2, (self.past[lo:hi] * 8 + (state >> 2))[:, None]), ("exact", 3, (last * 8 + (state >> 2))[:, None])]
        return slots, self.right[at][:, None], None, None

    def word(self, lo: int, hi: int) -> tuple[list, np.ndarray, np.ndarray | None, np.ndarray | None]:
        at = self.coded[lo:hi]
        cell = self.cell[self.slice.tokens[at]]
        slots, node = [("exact", 0, NODES.take(cell, 0))], _NODE_HASH.take(cell, 0)
        for k, context in enumerate((self.slice.before, self.slice.second)):
            slot = node ^ mix(context[at] + np.uint64(k + 1))[:, None]
            slot *= _B
            slot >>= np.uint64(64 - self.bits)
            slots.append(("word", k, slot.view(np.int64)))
        return slots, BITS.take(cell, 0), TOLD.take(cell, 0), self.slice.train[at]

    def spell(self, lo: int, hi: int) -> tuple[list, np.ndarray, np.ndarray | None, np.ndarray | None]:
        # Contexts reach back to the word's start, so read from there.
        of = self.letter_of[lo:hi]
        begin = int(np.searchsorted(self.letter_of, of[0])) if len(of) else lo
        data, of = self.letters[begin:hi].astype(np.uint64), self.letter_of[begin:hi]
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        depth = np.arange(len(data)) - np.repeat(new, np.diff(np.r_[new, len(data)]))
        last, contexts = np.zeros(len(data), np.uint64), []
        for k in (1, 2, 3):
            byte = np.zeros(len(data), np.uint64)
            byte[k:] = data[:-k] + np.uint64(1)
            byte[depth < k] = 0
            last = last << np.uint64(9) | byte
            contexts.append(last)
        code = mix(data * _A + depth.astype(np.uint64) * _C)
        sums = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
        contexts.append(sums[:-1] - sums[np.arange(len(data)) - depth])
        contexts.append(contexts[1] + self.slice.before[self.spelt[of]] * _C)
        keep = slice(lo - begin, None)
        byte, slots = data[keep].astype(np.int64), []
        node = _BYTE_NODES.take(byte, 0)
        for k, c in enumerate(contexts):
            slot = node ^ mix(c[keep] * _B + np.uint64(k + 1))[:, None]
            slot *= _B
            slot >>= np.uint64(64 - SPELL_BITS)
            slots.append(("spell", k, slot.view(np.int64)))
        token = self.spelt[of[keep]]
        own = self.slice.train[token] & (self.count[self.slice.tokens[token]] == 1)
        return slots, _BYTE_BITS.take(byte, 0), None, own

    def steps(self, kind: str) -> Iterator[tuple]:
        n = int(self.units(kind).sum())
        for lo in range(0, n, STEP):
            yield getattr(self, kind)(lo, min(n, lo + STEP))

    def learning(self, kind: str, lo: int, hi: int) -> np.ndarray:
        token = {"follow": self.asked, "word": self.coded}[kind][lo:hi] if kind != "spell" else self.spelt[self.letter_of[lo:hi]]
        return self.slice.train[token]


def inputs(tables: dict, slots: list, bits: np.ndarray, own: np.ndarray | None) -> list[np.ndarray]:
    """Stretched predictions by context: units x bits. own: the units whose own occurrence is left out."""
    which = None if own is None else (own[:, None] * (1 + bits.astype(np.uint32))) << np.uint32(16)
    return [tables[name][table].take(slot) if name == "exact" else STRETCH.take(tables[name][table].take(slot) + which) for name, table, slot in slots]


def read(length: np.ndarray, make: Callable, kind: str) -> np.ndarray:
    """The cost in bits of each document's units; length: units a document. make(lo, hi): predictions, bits and told ones.

    Each document begins with the kind's weights, the same at all gates; they move after every BLOCK of its units, for
    all documents at once.
    """
    ends = np.cumsum(length)
    cost, at, left, n = np.zeros(len(length)), 0, None, int(length.sum())
    gates, start, rate = KINDS[kind]
    while at < n:
        whole = int(np.searchsorted(ends, at + STEP, "right"))
        cut = int(ends[whole - 1]) if whole and ends[whole - 1] > at else at + STEP  # whole documents, or blocks of a long one
        x, bits, told = make(at, cut)
        docs = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, cut - 1, "right") + 1)
        docs = docs[length[docs] > 0]
        begin = np.maximum(ends[docs] - length[docs], at) - at
        size = np.minimum(ends[docs], cut) - at - begin
        # Each document is padded to whole blocks; units of padding don't count.
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        inside = np.arange(int(blocks.sum()) * BLOCK) - np.repeat(first * BLOCK, blocks * BLOCK)
        use = inside < np.repeat(size, blocks * BLOCK)
        unit = np.where(use, np.repeat(begin, blocks * BLOCK) + inside, 0)
        shape = (-1, BLOCK, bits.shape[1])
        x = [v.take(unit, 0).reshape(shape) for v in x]
        sign = (1 - 2 * bits.astype(np.float32)).take(unit, 0)  # -1 where the bit is one
        use = (use[:, None] if told is None else use[:, None] & told.take(unit, 0)).astype(np.float32)
        sign, use = sign.reshape(shape), np.broadcast_to(use, (len(unit), bits.shape[1])).reshape(shape)
        weights = [np.full((len(docs), gates), w, np.float32) for w in start]
        if left is not None:
            for k, w in enumerate(weights):
                w[0] = left[k]
        order = np.argsort(-blocks, kind="stable")
        falling = -blocks[order]
        for t in range(int(blocks.max())):
            some = order[: np.searchsorted(falling, -t, "left")]
            here = first[some] + t
            xs, back, counts = [v[here] for v in x], sign[here], use[here]
            z = np.zeros(back.shape, np.float32)
            for k, v in enumerate(xs):
                z += v * weights[k][some][:, None]
            np.clip(z, -15, 15, out=z)
            z *= back
            np.exp(z, out=z)  # the odds against the bit
            cost[docs[some]] += (np.log(1 + z) * counts).sum((1, 2), dtype=np.float64)
            z /= 1 + z
            z *= back
            z *= counts
            for k, v in enumerate(xs):
                weights[k][some] -= np.float32(rate) * (z * v).sum(1)
        left = [w[-1] for w in weights] if cut < ends[docs[-1]] else None
        at = cut
    return cost / np.log(2)


# --- Learning and scoring ------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for pdf in batches:
        yield from pdf.itertuples()


def context_counts(slices_: DataFrame, bits: int) -> np.ndarray:
    """Zeros and ones by table and slot over all training texts."""
    place = layout(bits)
    size = sum(2 * t * n for _, t, n in place.values())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(-(-size // _PART) * _PART, np.uint32)
        for row in _rows(batches):
            d = Decisions(row, bits)
            for kind in KINDS:
                lo = 0
                for slots, y, told, own in d.steps(kind):
                    # Of spelled words those that occur once, where they occur.
                    use = np.broadcast_to((own if kind == "spell" else d.learning(kind, lo, lo + len(y)))[:, None], y.shape)
                    use = np.flatnonzero(use if told is None else use & told)
                    lo += len(y)
                    y = y.ravel().take(use)
                    for name, table, slot in slots:
                        begin, _, n = place[name]
                        np.add.at(total, 2 * slot.ravel().take(use) + (y + (begin + 2 * table * n)), np.uint32(1))
        flat = total.reshape(-1, _PART)
        for i in np.flatnonzero(flat.any(1)):
            yield pd.DataFrame({"part": [int(i)], "n": [packed(flat[i])]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_PART, np.uint64)
        for pdf in batches:
            for x in pdf["n"]:
                total += unpacked(x, np.uint32)
        yield pd.DataFrame({"part": [key[0]], "n": [packed(total)]})

    out = np.zeros((-(-size // _PART), _PART), np.uint64)
    held = slices_.agg(F.sum(F.octet_length("refs") + F.octet_length("words"))).first()[0] or 0
    few = slices_.coalesce(max(slices_.sparkSession.sparkContext.defaultParallelism, held // COUNTED))
    for row in few.mapInPandas(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary").collect():  # bounded by WORD_BITS
        out[row.part] = unpacked(row.n, np.uint64)
    return out.ravel()[:size]


def log_scores(d: Decisions, tables: dict, cell_sums: np.ndarray) -> np.ndarray:
    """log10 probabilities of a slice's documents."""
    s, cost = d.slice, np.zeros(len(d.slice.lengths))
    for kind in KINDS:
        def make(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            slots, bits, told, own = getattr(d, kind)(lo, hi)  # noqa: B023
            return inputs(tables, slots, bits, own), bits, told

        cost += read(d.units(kind), make, kind)
    word = s.tokens
    rest = np.where(d.right[np.arange(len(word))], d.share[word], np.where(d.count[word] < 2, 1.0, d.count[word] / np.maximum(cell_sums, 1)[d.cell[word]]))
    cost -= np.bincount(s.owner, weights=np.log2(np.maximum(rest, 1e-30)), minlength=len(cost))
    return -cost * np.log10(2)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    gathered = written(gather(docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))), "gathered")
    size = gathered.agg(F.coalesce(F.sum(F.octet_length("refs")), F.lit(0))).first()[0]  # about two bytes a word
    buckets = int(np.clip(size // 2 // GROUP, 8, 1 << 16))
    counted = written(word_counts(gathered, buckets), "counted")
    n_sums = 2 + (CLASSES << HASH_BITS)
    sums = counted.filter("slice = -1").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    total, distinct, *cell_sums = (lambda d: [d.get(i, 0) for i in range(n_sums)])({r.pos: r.n for r in sums})
    slices_ = written(joined(gathered, counted, followers(gathered, buckets)), "slices")
    bits = int(np.clip(np.ceil(np.log2(max(total, 1))), 14, WORD_BITS))
    tables = spark.sparkContext.broadcast(tables_of(context_counts(slices_, bits), bits))
    cell_sums = np.array(cell_sums, np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            d = Decisions(row, bits)
            s, sizes = d.slice, unpacked(row.sizes, np.uint64)
            add = lambda v: np.bincount(s.owner, weights=v[s.tokens], minlength=len(s.lengths))  # noqa: B023, E731
            logs = log_scores(d, tables.value, cell_sums)
            yield pd.DataFrame({
                "k": s.ids, "held_out": ~s.learn, "n_tokens": s.lengths, "n_known": add(d.count > 0).astype(np.int64), "base_score": add(np.log10((d.count.astype(np.float64) + 1) / (total + distinct + 1))),
                "score": logs, "bits_per_byte": -logs * np.log2(10) / np.maximum(sizes, 1),
            })

    out = slices_.mapInPandas(run, "k string, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
