"""Texts of an Arrow column as numpy arrays: bytes, words and their hashes.

Words are runs of other bytes than space and \\t to \\r. All work is vectorised over slices of a batch of a few MB,
so memory stays bounded by the slice or by one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 3 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: All ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


class _Cache(dict):
    """A cache that isn't sent along with the functions that use it."""

    def __reduce__(self):
        return _Cache, ()


_POWERS: dict[int, np.ndarray] = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for base, key in ((_STEP, 0), (pow(_STEP, -1, 1 << 64), 1)):
        if key not in _POWERS or len(_POWERS[key]) < n:
            out = np.full(max(n, SLICE), base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, lower-case bytes, offsets) of slices of about SLICE bytes; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi, _LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, which the bytes marked in breaks part."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~breaks[data]
    first = np.zeros(len(data) + 2, bool)
    first[offsets + 1] = True  # a text ends the word of the text before
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | first[1:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | first[2:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MUL)


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of the windows of so many words; a shorter text is one window."""
    n = len(hashes)
    if not n:
        return hashes, owner
    factors = mix(np.arange(11, 11 + size, dtype=np.uint64) * _MUL) | np.uint64(1)
    out, where = [], []
    if n >= size:
        full = owner[: n - size + 1] == owner[size - 1 :]
        at = np.flatnonzero(full)
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h += hashes[at + k] * factors[k]
        out.append(mix(h))
        where.append(owner[at])
    count = np.bincount(owner, minlength=int(owner[-1]) + 1)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            h[has] += hashes[begin[short[has]] + k] * factors[k]
        out.append(mix(h + count[short].astype(np.uint64) * _MUL))
        where.append(short)
    return np.concatenate(out), np.concatenate(where)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes, bounds): the sorted distinct shingles of row lo + i are hashes[bounds[i]:bounds[i + 1]]."""
    for lo, hi, data, offsets in slices(texts):
        starts, ends, owner = words(data, offsets)
        h, d = shingles(word_hashes(data, starts, ends), owner, size)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        yield lo, hi, h, np.searchsorted(d, np.arange(hi - lo + 1))


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers below 2^32, then the next ones: small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(blob: bytes) -> np.ndarray:
    """The numbers of planes()."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
