"""Periodic runs of words by the linear-time tandem-repeat method of Gusfield and Stoye.

A text's words are numbered. Names of all windows of 1, 2, 4, ... words, each from two names of half the width, give the
suffix array, and common extensions to either side in a few lookups. Then, for all texts of a slice at once:

1. Lempel-Ziv blocks: for each block, the squares that its borders show are a leftmost-covering set.
2. Suffix-link walks complete the vocabulary: from the place of a square in the suffix tree (an interval of the suffix
   array at its depth) the link leads to the place of the next rotation, as long as that is a square too.
3. Every leaf below a place is an occurrence. Occurrences of one period at consecutive words merge into a run.

Squares of a root that is a power itself are left out before 2: their runs are those of the root, and with them the
located squares would grow quadratically. Before 1, words that can't be in a run go: a run of 12 words or more has two
equal windows of 6 words a period apart, and such windows cover it. Words are compared as they are; hashes only choose
what is looked at.

Defined results: null, empty and blank texts have no words and no runs; words are runs of other characters than space
and \\t to \\r, and case counts; repeated rows and ids are judged alike, each by itself; a text of any length is looked
at whole (memory follows the longest text's repeated part); an empty table gives an empty one; other columns pass
through, and n_runs, runs, n_words and collapsed replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.text_arrays import mix

#: A run's least words, and the words of the windows that are looked for first (LEAST / 2 at most).
LEAST = 12
WINDOW = LEAST // 2
#: Bytes of text that are worked on at once, and pairs of words of one step.
SLICE, STEP = 4 << 20, 1 << 19
_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def covered(words: np.ndarray, part: np.ndarray, window: int) -> np.ndarray:
    """Whether a word is in a window of so many words that its part (a number by word, ascending) has twice."""
    n = len(words)
    out = np.zeros(n + 1, np.int32)
    if n >= window:
        key = part[: n - window + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(window):
            key = (key ^ words[k : n - window + 1 + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        at = np.flatnonzero(part[: n - window + 1] == part[window - 1 :])
        key = mix(key[at])
        bits = max(12, int(len(at)).bit_length() + 2)
        place = (key >> np.uint64(64 - bits)).astype(np.int64)  # most windows are alone in their slot
        some = np.bincount(place, minlength=1 << bits)[place] > 1
        at, key = at[some], key[some]
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        at = at[order[same[1:] | same[:-1]]]
        np.add.at(out, at, 1)
        np.add.at(out, at + window, -1)
    return np.cumsum(out)[:n] > 0


def candidates(words: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (as places, ascending) that a run may have, and for each the number of its stretch: runs don't cross stretches."""
    at, part, window = np.arange(len(words)), part, least // 2
    while len(at):
        inside = covered(words[at], part, window)
        kept = at[inside]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (np.diff(part[inside]) > 0)
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch)[stretch] >= least if len(kept) else np.zeros(0, bool)
        kept, stretch = kept[long], stretch[long]
        if len(kept) == len(at) or 4 * len(kept) > 3 * len(at):
            return kept, stretch
        at, part = kept, stretch
    return at, np.zeros(0, np.int64)


class Names:
    """Names of all windows of 2^p symbols: equal names, equal windows. The last names tell all suffixes apart, in their order."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), [symbols.astype(np.int32)]
        width = 1
        while True:
            last = self.levels[-1]
            key = (last.astype(np.int64) + 1) << 32
            key[: self.n - width] |= last[width:].astype(np.int64) + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            name = np.empty(self.n, np.int32)
            name[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            self.levels.append(name)
            width *= 2
            if name[order[-1]] == self.n - 1:
                break
        self.suffixes, self.rank = order, name

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on, for different i and j up to n."""
        out, n = np.zeros(len(i), np.int64), self.n
        for p in range(len(self.levels) - 2, -1, -1):
            a, b, name = i + out, j + out, self.levels[p]
            out += ((a < n) & (b < n) & (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)])).astype(np.int64) << p
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i equal those up to j, for different i and j from -1 on."""
        out = np.zeros(len(i), np.int64)
        for p in range(len(self.levels) - 2, -1, -1):
            a, b, name = i - out - (1 << p) + 1, j - out - (1 << p) + 1, self.levels[p]
            out += ((a >= 0) & (b >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << p
        return out


class SuffixTree:
    """Places in the suffix tree as intervals of the suffix array."""

    def __init__(self, names: Names):
        s = names.suffixes
        self.names = names
        low = np.r_[0, names.ahead(s[:-1], s[1:])].astype(np.int32)  # of a suffix with the one before it
        self.lows = [low]
        while 2 << len(self.lows) - 1 <= names.n:
            w = 1 << len(self.lows) - 1
            last = self.lows[-1]
            self.lows.append(np.minimum(last[: len(last) - w], last[w:]))

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the place that the suffix from at has at this depth."""
        first = self.names.rank[at].astype(np.int64)
        last, n = first.copy(), self.names.n
        for p in range(len(self.lows) - 1, -1, -1):
            low, w = self.lows[p], 1 << p
            x = first - w + 1
            first -= w * ((x >= 1) & (low[np.clip(x, 0, len(low) - 1)] >= depth))
            x = last + 1
            last += w * ((x + w <= n) & (low[np.minimum(x, len(low) - 1)] >= depth))
        return first, last


def blocks(names: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest that began before already, or one symbol."""
    s = names.suffixes.tolist()
    n = names.n
    before, after, stack = [-1] * n, [-1] * n, []  # the nearest suffixes in order that start further left
    for x in s:
        while stack and stack[-1] > x:
            after[stack.pop()] = x
        if stack:
            before[x] = stack[-1]
        stack.append(x)
    at = np.arange(n)
    longest = np.ones(n, np.int64)
    for other in (np.array(before), np.array(after)):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], names.ahead(at[has], other[has]))
    step, out, h = longest.tolist(), [], 0
    while h < n:
        out.append(h)
        h += step[h]
    return np.array(out)


def _counted(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number) for the numbers 1 to sizes of each row, in steps of about STEP."""
    ends = np.cumsum(sizes)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        x = np.arange(lo, min(lo + STEP, int(ends[-1])))
        row = np.searchsorted(ends, x, "right")
        yield row, x - (ends[row] - sizes[row]) + 1


def leftmost_cover(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of squares, so that every square's first occurrence follows one of them through squares of that length."""
    h = blocks(names)
    end = np.r_[h[1:], names.n]
    size = end - h
    starts, halves = [], []
    for row, k in _counted(h, size):  # the right half reaches into the next block
        e = end[row]
        q = e - k
        some = e < names.n
        e, q, k = e[some], q[some], k[some]
        right, left = names.ahead(e, q), names.behind(e - 1, q - 1)
        good = (right + left >= k) & (right > 0)
        starts.append(np.maximum(q - left, q - k + 1)[good])
        halves.append(k[good])
    for row, k in _counted(h, size + np.r_[size[1:], 0]):  # the left half begins before the block
        b = h[row]
        q = b + k
        some = (b > 0) & (q < names.n)
        b, q, k, e = b[some], q[some], k[some], end[row][some]
        right, left = names.ahead(b, q), names.behind(b - 1, q - 1)
        start = np.maximum(b - left, b - k + 1)
        good = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= e)
        starts.append(start[good])
        halves.append(k[good])
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*halves, np.zeros(0, np.int64)])


def _divisors(most: int) -> np.ndarray:
    """The smallest prime that divides a number, up to the greatest number."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part == np.arange(p * p, most + 1, p)] = p
    return out


def primitive(names: Names, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half is no power of something shorter."""
    out, rest, by = np.ones(len(half), bool), half.copy(), _divisors(int(half.max(initial=1)))
    while len(live := np.flatnonzero(out & (rest > 1))):
        p, k = by[rest[live]], half[live]
        d = k // p
        out[live] = names.ahead(start[live], start[live] + d) < 2 * k - d
        rest[live] //= p
    return out


def repetitions(symbols: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of the runs of symbols (numbers from 0) that have at least so many symbols."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    names = Names(symbols)
    start, half = leftmost_cover(names)
    start, half = np.divmod(np.unique(start * len(symbols) + half), len(symbols))
    kept = primitive(names, start, half)
    start, half = start[kept], half[kept]
    if not len(start):
        return none, none, none
    tree, found = SuffixTree(names), []
    links = np.minimum(names.ahead(start, start + half) - half, half - 1) + 1  # rotations on the walk, the first included
    for row, k in _counted(start, links):
        first, last = tree.interval(start[row] + k - 1, 2 * half[row])
        found.append(np.unique(np.stack((half[row], first, last), 1), axis=0) if len(first) else np.zeros((0, 3), np.int64))
    places = np.unique(np.concatenate(found), axis=0)
    half, first, last = places.T
    keys = []
    for row, k in _counted(first, last - first + 1):
        keys.append(half[row] * len(symbols) + names.suffixes[first[row] + k - 1])
    period, at = np.divmod(np.sort(np.concatenate(keys)), len(symbols))
    new = np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)]
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(at)] - 1
    start, period = at[begin], period[begin]
    length = at[stop] + 2 * period - start
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words of many texts (text: a number by word, ascending); start is a word's place among all."""
    at, stretch = candidates(words, text, least)
    if not len(at):
        return at, at, at
    symbols = np.unique(stretch << 32 | words[at], return_inverse=True)[1]  # a stretch has symbols of its own
    start, length, period = repetitions(symbols, least)
    return at[start], length, period


def _batches(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def measured(texts: list[bytes | None], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, tuple, list[bytes]]:
    """Words of each text, its runs' number, the runs (start within the text, length, period) and the collapsed texts."""
    numbers, words, counts, places = _Numbers(), [], [], []
    for t in texts:
        w = t.split() if t else []
        words.append(w)
        counts.append(len(w))
        places.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
    counts = np.array(counts, np.int64)
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)
    start, length, period = runs_of(np.concatenate([*places, np.zeros(0, np.int64)]), text, least)
    whose = text[start]
    drop = np.zeros(len(text) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    drop = np.cumsum(drop)[:-1] > 0
    for i in np.unique(whose).tolist():
        gone = drop[begin[i] : begin[i] + counts[i]].tolist()
        words[i] = [w for w, g in zip(words[i], gone, strict=True) if not g]
    return counts, np.bincount(whose, minlength=len(texts)), (start - begin[whose], length, period), [b" ".join(w) for w in words]


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with n_words, n_runs, runs (start, length, period by start, then period) and collapsed: the words joined by one
    space, without those that a run has after its first period. Texts are independent, so nothing is shuffled."""
    own = {"n_words", "n_runs", "runs", "collapsed"}
    names = [c for c in docs.columns if c.lower() not in own]
    source = "_text"
    while source.lower() in {c.lower() for c in names}:
        source += "_"
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias(source))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType()), T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(len(names))), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _batches(sizes, SLICE):
                part = b.slice(lo, hi - lo)
                n_words, n_runs, found, collapsed = measured(part.column(len(names)).to_pylist(), least)
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_runs)], pa.int32()), each)
                out = [pa.array(n_words, pa.int64()), pa.array(n_runs, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *out], [*names, *(f.name for f in fields)])

    return rows.mapInArrow(run, T.StructType([*rows.drop(source).schema, *fields]))


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs where every tenth text by its id's hash h goes on periodically from word a = h / 10 modulo its words; see op13_tandem_runs."""
    c = F.col(text).cast("string")
    h = F.crc32(F.col(key).cast("string"))
    g, hit = F.floor(h / 10), h % 10 == 0
    words = F.regexp_extract_all(F.when(hit, c), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = docs.select("*", words.alias("_w"), g.alias("_g")).withColumn("_n", F.size("_w"))
    made = made.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    tail = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % _p as int)])), ' ')")
    return made.select(*[F.when(F.col("_n") > 0, tail).otherwise(c).alias(x) if x == text else F.col(f"`{x}`") for x in docs.columns])


def op13_tandem_runs(spark, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = with_runs(docs)
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    told = found.select("doc_id", "n_runs", best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("_b.length"), F.col("_b.period")
    return told.select("doc_id", "n_runs", F.col("_b.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: crc32 of the decimal id: each character is put in, then come eight steps of a bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents
), g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[a + (i - 1 - a) % p + 1] END) END AS w FROM p),
x AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT x.r, y.i - x.i AS q, x.i AS i FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST}, 2 * q)),
u AS (SELECT r, start, length, min(q) AS q FROM s GROUP BY ALL),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, min({{'l': -length, 's': start, 'q': q}}) AS best FROM u GROUP BY r),
k AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(start + q, start + length)) AS i FROM u)),
c AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN k ON x.r = k.r AND x.i = k.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, (1000 * -best.l) // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.r = b.r LEFT JOIN c ON t.r = c.r"""
