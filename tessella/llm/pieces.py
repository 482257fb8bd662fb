"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch that aren't known yet are joined to one text. Its suffixes are sorted, every piece of the
vocabulary is looked up by binary search, and its range of suffixes gives an edge for each occurrence. The edges are
sorted by where they end and relaxed in that order. The vocabulary is a BPE, so an edge is taken when its piece may
stand after the piece that the best path to its start ends with: exactly one edge into each position passes, and the
path to a word's end is the encoding that merging by score gives. Characters without a piece become byte pieces.

The model is read on the driver and broadcast (its size is fixed); workers keep a bounded memo of encoded words.

Defined results: a null or empty text has no pieces; a space is written as U+2581, so a U+2581 of the text comes back
as a space, and all else exactly; runs of several spaces, whose pieces tie in score, are merged pair by pair; repeated
rows are coded alike; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words that a worker remembers, and characters of new words in one batch.
MEMO, BATCH = 500_000, 1 << 20
#: Pairs of pieces whose test is remembered, about; then it starts anew.
TESTED = 1 << 20
_RUN = re.compile(f"{SPACE}*[^{SPACE}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Memo(dict):
    """Numbers of words, given as they are first asked for (new), and the piece ids of the words that are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The piece ids of the new words, in their order."""
        self.ids, self.counts, self.new = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts)), []
        self.starts = np.cumsum(self.counts) - self.counts


class Vocabulary:
    """Pieces by rank (a merge of a better score has a smaller one; single characters come first), with their splits."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {bytes.fromhex(self.text[i][3:5])[0]: i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        usable = [i for i in ids if i not in self.byte_of and i not in self.special and not model.is_unused(i)]
        self.score = {self.text[i]: model.get_score(i) for i in usable}
        usable.sort(key=lambda i: (len(self.text[i]) > 1, -model.get_score(i), i))
        self.ids = np.array(usable, np.int64)
        self.pieces = [self.text[i] for i in usable]
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.splits = np.tile(np.arange(len(usable))[:, None], (1, 2))
        self.reachable = np.ones(len(usable), bool)
        for r, p in enumerate(self.pieces):
            if len(p) > 1:
                last = self.merge(p, stop=2)
                self.reachable[r] = len(last) == 2 and all(x in self.rank for x in last)
                if self.reachable[r]:
                    self.splits[r] = [self.rank[x] for x in last]
        joined = [((self.rank[p[:k]] << 32) | self.rank[p[k:]], r) for r, p in enumerate(self.pieces) for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank]
        joined.sort()
        self.joins, self.join_rank = np.array([j for j, _ in joined], np.int64), np.array([r for _, r in joined], np.int64)
        self.longest = max(map(len, self.pieces))
        self.codes = np.zeros((len(usable), self.longest), np.uint32)
        for r, p in enumerate(self.pieces):
            self.codes[r, : len(p)] = [ord(c) for c in p]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.memo = Memo()
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.text[i].replace(SPACE, " ").encode() for i in ids]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.tested, self.test_result = np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, text: str, stop: int = 1) -> list[str]:
        """The symbols of a text after all merges, the best score first and of equal scores the leftmost; or the last stop symbols of a piece."""
        symbols, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (s := self.score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

        for i in range(len(text) - 1):
            offer(i)
        left = len(text)
        while heap and left > stop:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            left -= 1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a (both as ranks): no merge across would come before those within."""
        key, back = np.unique((a << 32) | b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.tested, key), max(len(self.tested) - 1, 0))
        known = self.tested[at] == key if len(self.tested) else np.zeros(len(key), bool)
        result = np.zeros(len(key), bool)
        if len(self.tested):
            result[known] = self.test_result[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.tested) > TESTED:
                self.tested, self.test_result = np.zeros(0, np.int64), np.zeros(0, bool)
            result[new] = self._apart(key[new] >> 32, key[new] & 0xFFFFFFFF)
            keys, values = np.r_[self.tested, key[new]], np.r_[self.test_result, result[new]]
            order = np.argsort(keys, kind="stable")
            self.tested, self.test_result = keys[order], values[order]
        return result[back]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the merges of both sides, the latest first; at each stage the merge across must not have been due."""
        a, b = a.copy(), b.copy()
        limit, out = np.full(len(a), 1 << 40), np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            due = (self.joins[at] == key) & (self.join_rank[at] < limit[live])
            out[live[due]] = False
            live, x, y = live[~due], x[~due], y[~due]
            left_open, right_open = self.splits[x, 0] != x, self.splits[y, 0] != y
            # Of two equal pieces the right one was merged later, and at its rank a merge across on the left came first.
            right = right_open & (~left_open | (x <= y))
            left = left_open & ~right
            limit[live[right]], b[live[right]] = y[right] + 1, self.splits[y[right], 0]
            limit[live[left]], a[live[left]] = x[left], self.splits[x[left], 1]
            live = live[right | left]
        return out


def occurrences(codes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece and place of every occurrence of a piece in the text, by its suffix array."""
    alphabet, rank = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    per = 63 // bits
    width = -(-vocabulary.longest // per)
    padded = np.r_[rank + 1, np.zeros(width * per, np.int64)]

    def keys(rows: np.ndarray, n: int) -> list[np.ndarray]:  # rows[i] gives column i of all strings
        return [sum(rows(c * per + i).astype(np.int64) << (bits * (per - 1 - i)) for i in range(per)) for c in range(n)]

    text = keys(lambda i: padded[i : i + len(codes)], width)
    order = np.lexsort(text[::-1])
    text = [k[order] for k in text]
    at = np.minimum(np.searchsorted(alphabet, vocabulary.codes), len(alphabet) - 1)
    inside = np.arange(vocabulary.longest) < vocabulary.lengths[:, None]
    pieces = np.flatnonzero(((alphabet[at] == vocabulary.codes) | ~inside).all(1) & vocabulary.reachable)
    low, high = np.where(inside, at + 1, 0)[pieces], np.where(inside, at + 1, (1 << bits) - 1)[pieces]
    columns = lambda m: lambda i: m[:, i] if i < m.shape[1] else np.zeros(len(m), np.int64) if m is low else np.full(len(m), (1 << bits) - 1)

    def bisect(want: list[np.ndarray], past: bool) -> np.ndarray:
        lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(codes))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            safe = np.minimum(mid, len(codes) - 1)
            less, equal = np.zeros(len(pieces), bool), np.ones(len(pieces), bool)
            for t, w in zip(text, want, strict=True):
                less |= equal & (t[safe] < w)
                equal &= t[safe] == w
            right = (less | equal if past else less) & (lo < hi)
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        return lo

    first, last = bisect(keys(columns(low), width), False), bisect(keys(columns(high), width), True)
    n = last - first
    return np.repeat(pieces, n), order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the words one after the other, and their number by word; a word has no SPACE but one at its start."""
    codes = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    begin = np.cumsum(lengths + 1) - lengths - 1
    whose = np.repeat(np.arange(len(words)), lengths + 1)[: len(codes)]
    piece, place = occurrences(codes, vocabulary)
    start = place - begin[whose[place]]
    end = start + vocabulary.lengths[piece]
    ok = (end <= lengths[whose[place]]) & (start < lengths[whose[place]])  # a word's own NULs may match, separators don't
    piece, place, start, end = piece[ok], place[ok], start[ok], end[ok]
    single = np.zeros(len(codes), bool)
    single[place[vocabulary.lengths[piece] == 1]] = True
    plain = np.flatnonzero(~single & (np.arange(len(codes)) - begin[whose] < lengths[whose]))  # characters without a piece
    none = len(vocabulary.pieces)
    piece, place = np.r_[piece, np.full(len(plain), none)], np.r_[place, plain]
    start, end = np.r_[start, plain - begin[whose[plain]]], np.r_[end, plain - begin[whose[plain]] + 1]
    order = np.argsort(end.astype(np.uint16) if end.max(initial=0) < 1 << 16 else end, kind="stable")
    piece, place, start, end = piece[order], place[order], start[order], end[order]
    last, origin = np.full(len(codes) + 1, -1), np.zeros(len(codes) + 1, np.int64)  # of the path that ends before a place
    cut = np.searchsorted(end, np.arange(1, int(lengths.max()) + 2))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        p, at, s, e = piece[a:b], place[a:b], start[a:b], end[a:b]
        before = last[at]
        good = (s == 0) | (before == none) | ((p == none) & (before >= 0))
        ask = np.flatnonzero((s > 0) & (before >= 0) & (before != none) & (p != none))
        good[ask] = vocabulary.may_follow(before[ask], p[ask])
        to = at[good] + e[good] - s[good]
        # The place after a word is its separator, so paths of different words never meet.
        last[to], origin[to] = p[good], at[good]
    at, word, taken = begin + lengths, begin, np.full(len(codes), -1)
    while len(at):  # all words back from their ends
        back = origin[at]
        taken[back] = last[at]
        go = back > word
        at, word = back[go], word[go]
    f = np.flatnonzero(taken >= 0)
    w, p = whose[f], taken[f]
    times = np.ones(len(p), np.int64)
    spelled = {int(i): chr(codes[f[i]]).encode() for i in np.flatnonzero(p == none)}
    for i, x in spelled.items():
        times[i] = len(x)
    ids, ends = np.repeat(np.r_[vocabulary.ids, -1][p].astype(np.int32), times), np.cumsum(times)
    for i, x in spelled.items():
        ids[ends[i] - len(x) : ends[i]] = [vocabulary.bytes[c] for c in x]
    bounds = np.r_[0, ends][np.searchsorted(w, np.arange(len(words) + 1))]
    return ids, np.diff(bounds)


def merged(word: str, vocabulary: Vocabulary) -> list[int]:
    """Piece ids by merging pair by pair."""
    out = []
    for x in vocabulary.merge(word):
        r = vocabulary.rank.get(x)
        out += [int(vocabulary.ids[r])] if r is not None else [vocabulary.bytes[c] for c in x.encode()]
    return out


def learn_words(vocabulary: Vocabulary) -> None:
    """Encodes the new words of the memo, in batches; words of several spaces go pair by pair."""
    memo = vocabulary.memo
    spaced = np.array([w.startswith(SPACE * 2) for w in memo.new], bool)
    plain, ids, counts = np.flatnonzero(~spaced), [], []
    size = np.cumsum([len(memo.new[i]) + 1 for i in plain])
    at = 0
    while at < len(plain):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, "right")))
        one = encode_words([memo.new[i] for i in plain[at:to]], vocabulary)
        ids.append(one[0])
        counts.append(one[1])
        at = to
    if spaced.any():
        total, odd = np.zeros(len(spaced), np.int64), {i: merged(memo.new[i], vocabulary) for i in np.flatnonzero(spaced).tolist()}
        total[plain] = np.concatenate(counts) if counts else 0
        for i, x in odd.items():
            total[i] = len(x)
        out, ends = np.zeros(int(total.sum()), np.int32), np.cumsum(total)
        out[np.repeat(~spaced, total)] = np.concatenate(ids) if ids else 0
        for i, x in odd.items():
            out[ends[i] - len(x) : ends[i]] = x
        memo.keep(out, total)
    elif counts:
        memo.keep(np.concatenate(ids), np.concatenate(counts))


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of flat, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def split_words(text: str) -> list[str]:
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return [w for w in _RUN.findall(SPACE + text.replace(" ", SPACE)) if w]
    return [SPACE + w for w in text.split(" ")]


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts one after the other, and their number by text."""
    if len(vocabulary.memo) > MEMO:
        vocabulary.memo = Memo()
    memo, numbers, n_words = vocabulary.memo, [], []
    for t in texts:
        words = split_words(t or "")
        numbers.extend(map(memo.__getitem__, words))
        n_words.append(len(words))
    learn_words(vocabulary)
    numbers, bounds = np.array(numbers, np.int64), np.r_[0, np.cumsum(n_words)]
    sizes = memo.counts[numbers]
    return _gather(memo.ids, memo.starts[numbers], sizes), np.diff(np.r_[0, np.cumsum(sizes)][bounds])


def decode_texts(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The texts of the ids between the bounds; bytes that aren't UTF-8 come out as U+FFFD."""
    sizes = vocabulary.raw_size[ids]
    data = _gather(vocabulary.raw, vocabulary.raw_at[ids], sizes).tobytes()
    at = np.r_[0, np.cumsum(sizes)][bounds].tolist()
    return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so much in all, and of one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids: array<int>."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    names = [c for c in docs.columns if c.lower() != "ids"]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _runs(pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(), 4 * BATCH):
                part = b.slice(lo, hi - lo)
                ids, counts = encode_texts(part.column(at).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), ids)], [*names, "ids"])

    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    return plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, to: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    names = [c for c in encoded.columns if c != to]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _runs(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(), BATCH):
                part = b.slice(lo, hi - lo)
                lists = part.column(at)
                bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
                texts = decode_texts(pc.drop_null(pc.list_flatten(lists)).to_numpy(), bounds, held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, to])

    plain = encoded.select(*[F.col(f"`{c}`") for c in names])
    return plain.mapInArrow(run, T.StructType([*plain.schema, T.StructField(to, T.StringType())]))


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs))
    exact = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" ")) == F.col("decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), exact.alias("round_trip"))
