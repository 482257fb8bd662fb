"""FLAC: mono streams of 8-bit samples, decoded and encoded in numpy over many frames at once.

A frame is constant, verbatim, fixed (order 0 to 4) or LPC, with Rice-coded residuals. encode() writes verbatim frames,
fixed ones up to order 2, and LPC ones with coefficients fitted to each frame, whichever is shortest, and a seek point
for every frame. Frames are worked on in runs of RUN, whatever the length of a text; those of a run are read in
lockstep, a sample of each at a time; CRC-8 of headers, CRC-16 of frames and the MD5 of the samples are verified.
decode() finds frames by the seek table, or one after the other where that is missing.

Defined results: a null or empty text is a payload of one padding unit; a text of any length is coded whole, in memory of
a few times its size; decode() raises ValueError for a stream that isn't FLAC of this kind or that fails a checksum,
decode_media() gives its message in the error column of that row, and digests() passes it on; repeated rows are coded
alike, ids play no part; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, BLOCK, UNIT = 8000, 4096, 64
#: Bytes of texts, and of streams, that are worked on together; a longer one is worked on alone.
STEP, READ_STEP = 1 << 20, 1 << 21
#: Frames that are worked on together.
RUN = 1024
#: Order, shift and bits of fitted coefficients.
ORDER, SHIFT, PRECISION = 4, 9, 12


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1 ^ poly) & ((1 << bits) - 1), out << 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


_SLICED = [_CRC16]  # _SLICED[i][b]: the remainder of byte b with i bytes after it
for _ in range(7):
    _SLICED.append(((_SLICED[-1] << 8) & 0xFFFF) ^ _CRC16[_SLICED[-1] >> 8])


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range, all ranges eight bytes at a time. Zeros before a range don't change its remainder."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    n = (ends - starts)[order]
    words = (n + 7) // 8
    first = np.cumsum(words) - words
    padded = np.zeros(int(words.sum()) * 8, np.uint8)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[np.repeat(first * 8 + words * 8 - n, n) + inside] = data[np.repeat(starts[order], n) + inside]
    own = np.zeros(len(padded) // 8, np.int64)
    for i in range(8):
        own ^= _SLICED[7 - i][padded[i::8]]
    c = np.zeros(len(n), np.int64)
    live = np.searchsorted(-words, -np.arange(words.max(initial=0)), "left")  # ranges of more than t words
    for t in range(words.max(initial=0)):
        k = live[t]
        c[:k] = _SLICED[7][c[:k] >> 8] ^ _SLICED[6][c[:k] & 255] ^ own[first[:k] + t]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >= 1 << (6 * k + 6 - k):
        k += 1
    return bytes([(0xFF00 >> (k + 1)) & 0xFF | n >> (6 * k)] + [0x80 | (n >> (6 * i)) & 0x3F for i in range(k - 1, -1, -1)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def fitted(x: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Coefficients of each frame by the recursion of Levinson and Durbin, scaled by SHIFT; plain arithmetic, so that equal frames get equal ones anywhere."""
    r = []
    for lag in range(ORDER + 1):
        products = np.zeros(len(x), np.int64)
        products[lag:] = x[lag:] * x[: len(x) - lag]
        products[place < lag] = 0
        r.append(np.add.reduceat(products, at).astype(np.float64))
    a, error = [], r[0] + 1.0
    for i in range(ORDER):
        k = r[i + 1].copy()
        for j in range(i):
            k -= a[j] * r[i - j]
        k /= error
        a = [a[j] - k * a[i - 1 - j] for j in range(i)] + [k]
        error = np.maximum(error * (1.0 - k * k), 1.0)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(np.array(a).T * (1 << SHIFT)), -most, most).astype(np.int64)


def encode(payloads: list[bytes], lpc: tuple[list[int], int, int] | str | None = "fit") -> list[bytes]:
    """FLAC streams of the payloads. lpc: "fit", or for all frames coefficients, shift and their bits, or None for none."""
    frames = [p[i : i + BLOCK] for p in payloads for i in range(0, len(p), BLOCK)]
    per = [-(-len(p) // BLOCK) for p in payloads]
    number = np.concatenate([np.arange(n) for n in per]) if payloads else np.zeros(0, np.int64)
    coded = [f for i in range(0, len(frames), RUN) for f in encode_frames(frames[i : i + RUN], number[i : i + RUN], lpc)]
    streams, a = [], 0
    for p, count in zip(payloads, per, strict=True):
        own, n = coded[a : a + count], [len(f) for f in frames[a : a + count]]
        block, sizes = BLOCK if count > 1 else n[0], [len(f) for f in own]
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        # A table holds some 932,000 points; a longer stream has none and is read one frame after the other.
        fits = count * 18 < 1 << 24
        seek = b"".join((f * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + n[f].to_bytes(2, "big") for f, at in enumerate(np.cumsum([0, *sizes[:-1]]).tolist())) if fits else b""
        streams.append(b"fLaC" + (b"\x00" if fits else b"\x80") + b"\x00\x00\x22" + info + (b"\x83" + len(seek).to_bytes(3, "big") + seek if fits else b"") + b"".join(own))
        a += count
    return streams


def encode_frames(frames: list[bytes], number: np.ndarray, lpc) -> list[bytes]:
    """The frames coded, each by its shortest predictor."""
    n = np.array([len(f) for f in frames], np.int64)
    at = np.cumsum(n) - n
    x = np.frombuffer(b"".join(frames), np.uint8).astype(np.int32) - 128
    place = np.arange(len(x)) - np.repeat(at, n)
    # Residuals of each predictor; the first samples of a frame are stored as they are.
    kinds, r = [(8, 0)], x
    residuals = [x]
    for order in (1, 2):
        r = np.r_[0, r[1:] - r[:-1]].astype(np.int32)
        kinds.append((8 + order, order))
        residuals.append(r)
    if lpc:
        coefs, shift, precision = (fitted(x, at, place), SHIFT, PRECISION) if lpc == "fit" else (np.tile(lpc[0], (len(n), 1)), *lpc[1:])
        guess = np.zeros(len(x), np.int32)
        for i in range(coefs.shape[1]):
            guess[i + 1 :] += (np.repeat(coefs[:, i].astype(np.int32), n)[i + 1 :] * x[: -i - 1])
        kinds.append((32 + coefs.shape[1] - 1, coefs.shape[1]))
        residuals.append((x - (guess >> shift)).astype(np.int32))
    best = np.full(len(n), 8, np.int64) * n
    pick, rice = np.full(len(n), -1), np.zeros(len(n), np.int64)
    zigs = []
    for i, ((_, order), res) in enumerate(zip(kinds, residuals, strict=True)):
        z = _zigzag(res)
        z[place < order] = 0
        zigs.append(z)
        extra = 10 + 8 * order + (9 + order * precision if i == 3 else 0)
        mean = np.add.reduceat(z, at) / np.maximum(n - order, 1)
        low = np.clip(np.log2(np.maximum(0.69 * mean, 1)).astype(np.int64), 0, 7)
        for k in (low, low + 1):  # the best parameter of a geometric distribution is one of these
            cost = np.add.reduceat(z >> np.repeat(k, n).astype(z.dtype), at) + (n - order) * (1 + k) + extra
            better = (cost < best) & (n > order)
            best[better], pick[better], rice[better] = cost[better], i, k[better]
    # Each sample as a run of zeros and a number of some bits.
    frame = np.repeat(np.arange(len(n)), n)
    order = np.array([o for _, o in kinds] + [0])[pick]
    coded = (place >= order[frame]) & (pick[frame] >= 0)
    z = np.choose(np.maximum(pick, 0)[frame], zigs)
    k = rice[frame]
    zeros = np.where(coded, z >> k, 0)
    value = np.where(coded, (1 << k) | (z & ((1 << k) - 1)), x & 0xFF)
    bits = np.where(coded, k + 1, 8)
    heads, fields = [], []
    for f in range(len(n)):
        h = b"\xff\xf8\x70\x02" + _number(int(number[f])) + int(n[f] - 1).to_bytes(2, "big")
        kind = 1 if pick[f] < 0 else kinds[pick[f]][0]
        heads.append(h + bytes([crc8(h), kind << 1]))
        if pick[f] < 0:
            fields.append((0, 0))
            continue
        field, width = rice[f], 10  # method 0, one partition, its parameter
        if kind >= 32:
            c = 0
            for v in coefs[f].tolist():
                c = c << precision | v & ((1 << precision) - 1)
            field = int(field) | (((precision - 1) << 5 | shift & 31) << (coefs.shape[1] * precision) | c) << 10
            width += 9 + coefs.shape[1] * precision
        fields.append((int(field), width))
    head = np.array([len(h) for h in heads]) * 8
    width = np.array([w for _, w in fields])
    total = np.add.reduceat(zeros + bits, at)
    length = (head + width + total + 7) // 8 + 2
    begin = np.cumsum(length) - length
    end = np.cumsum(zeros + bits)
    last = end - np.repeat(end[at] - (zeros + bits)[at], n) + (begin * 8 + head)[frame] - 1 + np.where(coded, width[frame], 0)
    value <<= 7 - (last & 7)  # a number of up to 9 bits lies in two bytes, and numbers don't overlap
    data = np.bincount(last >> 3, value & 255, int(length.sum())) + np.bincount((last >> 3) - 1, value >> 8, int(length.sum()))
    data = data.astype(np.uint8)
    for f, h in enumerate(heads):
        data[begin[f] : begin[f] + len(h)] = np.frombuffer(h, np.uint8)
        if width[f]:
            start = int(begin[f]) * 8 + int(head[f]) + 8 * int(order[f])
            lo, hi = start // 8, (start + int(width[f]) + 7) // 8
            word = int.from_bytes(data[lo:hi].tobytes(), "big") | fields[f][0] << (hi * 8 - start - int(width[f]))
            data[lo:hi] = np.frombuffer(word.to_bytes(hi - lo, "big"), np.uint8)
    check = crc16(data, begin, begin + length - 2)
    data[begin + length - 2], data[begin + length - 1] = check >> 8, check & 255
    return [data[i : i + k].tobytes() for i, k in zip(begin, length, strict=True)]


def _header(data: bytes, at: int) -> tuple[int, int, int, int, int]:
    """Samples, subframe kind, its order, the bit where its samples begin, and the frame number, of the frame at this byte."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame at the sought place")
    size, rate, sample = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
    if data[at + 3] >> 4 or sample not in (0, 1):
        raise ValueError("only mono streams of 8 bits are read")
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else next(k for k in range(1, 8) if not lead << k & 0x40)
    number = lead if not more else lead & (0x3F >> more)
    for b in data[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if size in (6, 7):
        n = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        n = 192 if size == 1 else 144 << size if 2 <= size <= 5 else 1 << size if size >= 8 else 0
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not n or crc8(data[at:p]) != data[p]:
        raise ValueError("a frame header fails its checksum")
    kind = data[p + 1] >> 1
    if data[p + 1] & 0x81:
        raise ValueError("wasted bits aren't read")
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else 0
    if not (kind in (0, 1) or 8 <= kind <= 12 or kind >= 32):
        raise ValueError("an unknown subframe")
    return n, kind, order, (p + 2) * 8, number


class _Reader:
    """Reads bits at many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.r_[data, np.zeros(16, np.uint8)]
        self.window = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            self.window |= padded[i : len(data) + 8 + i].astype(np.uint64) << np.uint64(56 - 8 * i)

    def at(self, at: np.ndarray) -> np.ndarray:
        """The bits from each place on, at the top; 57 of them at least."""
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)

    def bits(self, at: np.ndarray, n) -> np.ndarray:
        """Unsigned numbers of n bits (0 to 32)."""
        n = np.asarray(n).astype(np.uint64)
        return np.where(n > 0, self.at(at) >> (np.uint64(64) - np.maximum(n, np.uint64(1))), np.uint64(0)).astype(np.int64)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Lengths of long runs of zeros."""
        out, live = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(live):
            v = self.bits(at[live] + out[live], 32)
            out[live] += 32 - np.frexp(v.astype(np.float64))[1]
            live = live[v == 0]
            if (at[live] + out[live] > 8 * len(self.window)).any():
                raise ValueError("a frame has no end")
        return out

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed Rice codes with k low bits, and where they end."""
        w = self.at(at)
        z = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if (z + k).max(initial=0) > 52:
            z = self.zeros(at)
            low = self.bits(at + z + 1, k)
        else:
            low = (w << (z + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        v = z << k | low
        return (v >> 1) ^ -(v & 1), at + z + 1 + k


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the ranges of n from each start."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the frame at each place, and where the frame ends."""
    raw = data.tobytes()
    heads = [_header(raw, int(s)) for s in starts]
    n, kind, order, at = (np.array(x, np.int64) for x in list(zip(*heads, strict=True))[:4])
    by = np.argsort(-n, kind="stable")
    n, kind, order, at = n[by], kind[by], order[by], at[by]
    read, begin = _Reader(data), np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)  # one frame after the other
    signed = lambda v, bits: v - ((v >> (bits - 1) & 1) << bits)
    live = np.searchsorted(-n, -np.arange(int(n.max())), "left")
    flat = kind == 0
    if flat.any():
        out[np.repeat(flat, n)] = np.repeat(signed(read.bits(at[flat], 8), 8), n[flat])
        at[flat] += 8
    plain = np.where(kind == 1, n, order)  # samples stored as they are
    plain[flat] = 0
    inside = _ranges(np.zeros(len(n), np.int64), plain)
    out[_ranges(begin, plain)] = signed(read.bits(np.repeat(at, plain) + 8 * inside, 8), 8)
    at += 8 * plain
    linear = np.flatnonzero(kind >= 32)
    precision = read.bits(at[linear], 4) + 1
    shift = signed(read.bits(at[linear] + 4, 5), 5)
    coefs = np.zeros((len(linear), int(order[linear].max(initial=0))), np.int64)
    for i in range(coefs.shape[1]):
        m = order[linear] > i
        coefs[m, i] = signed(read.bits(at[linear[m]] + 9 + i * precision[m], precision[m]), precision[m])
    if (shift < 0).any():
        raise ValueError("a negative shift isn't read")
    at[linear] += 9 + order[linear] * precision
    rice = kind >= 8
    wide = np.where(rice, 4 + read.bits(at, 2), 4)
    parts = np.where(rice, read.bits(at + 2, 4), 0)
    at += np.where(rice, 6, 0)
    k, escape, span = np.zeros(len(n), np.int64), np.full(len(n), -1), n >> parts
    coded, several, escaped = np.flatnonzero(rice), bool((parts > 0).any()), False
    until = np.searchsorted(coded, live, "left")  # of the coded frames, those that are longer than t come first
    for t in range(int(n[coded].max(initial=0))):
        m = coded[: until[t]]
        if t <= 32:
            m = m[order[m] <= t]
        if t <= 32 or several:
            new = m[(order[m] == t) | (t % span[m] == 0)]
            if len(new):
                k[new] = read.bits(at[new], wide[new])
                at[new] += wide[new]
                raw_bits = k[new] == (1 << wide[new]) - 1
                escape[new] = -1
                if raw_bits.any():
                    e, escaped = new[raw_bits], True
                    escape[e] = read.bits(at[e], 5)
                    at[e] += 5
        p = at[m]
        if escaped and (escape[m] >= 0).any():
            e = escape[m] >= 0
            v, end = read.rice(p, np.where(e, 0, k[m])) if not e.all() else (np.zeros(len(m), np.int64), p.copy())
            b = escape[m][e]
            u = read.bits(p[e], b)
            v[e], end[e] = np.where(b > 0, u - ((u >> np.maximum(b - 1, 0) & 1) << b), 0), p[e] + b
        else:
            v, end = read.rice(p, k[m])
        out[begin[m] + t] = v
        at[m] = end
    # Fixed predictors are sums of differences: the first samples become differences, then each order is summed up.
    fixed = np.where((kind > 8) & (kind <= 12), order, 0)
    for i in range(1, int(fixed.max(initial=0))):
        for j in range(int(fixed.max()) - 1, i - 1, -1):
            f = begin[fixed > j] + j
            out[f] -= out[f - 1]
    for i in range(int(fixed.max(initial=0)) - 1, -1, -1):
        f = np.flatnonzero(fixed > i)
        where, size = _ranges(begin[f] + i, n[f] - i), n[f] - i
        total = np.cumsum(out[where])
        first = np.cumsum(size) - size
        out[where] = total - np.repeat(total[first] - out[where[first]], size)
    if len(linear):  # a row a sample, a column a frame, the longest first
        most, size = coefs.shape[1], n[linear]
        place, frame = _ranges(np.zeros(len(linear), np.int64), size) + most, np.repeat(np.arange(len(linear)), size)
        whole, where = np.zeros((most + int(size.max()), len(linear)), np.int32), _ranges(begin[linear], size)
        whole[place, frame] = out[where]
        terms, down, longer = np.ascontiguousarray(coefs.T.astype(np.int32)), shift.astype(np.int32), np.searchsorted(-size, -np.arange(int(size.max())), "left").tolist()
        for t, k in enumerate(longer):
            guess = terms[0, :k] * whole[most + t - 1, :k]
            for i in range(1, most):  # coefficients beyond a frame's order are 0
                guess += terms[i, :k] * whole[most + t - 1 - i, :k]
            guess >>= down[:k]
            if t < most:
                guess[order[linear[:k]] > t] = 0
            whole[most + t, :k] += guess
        out[where] = whole[place, frame]
    ends = (at + 7) // 8 + 2
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    ends = ends[back]
    if (ends > len(data)).any() or (crc16(data, starts, ends - 2) != (data[ends - 2].astype(np.int64) << 8 | data[ends - 1])).any():
        raise ValueError("a frame fails its checksum")
    return [out[begin[j] : begin[j] + n[j]] for j in back], ends


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its blocks in order: sample offset and PCM bytes (unsigned 8 bits)."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0] + [len(s) for s in streams])
    total, md5, points, after = [], [], [], []
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, seek = 4, False, None
        while not last:
            kind, size, last = s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big"), s[at] >= 128
            block = s[at + 4 : at + 4 + size]
            if kind == 0:
                total.append(int.from_bytes(block[10:18], "big") & ((1 << 36) - 1))
                md5.append(block[18:34])
            elif kind == 3:
                seek = sorted({(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, size, 18)} - {(2**64 - 1, 0, 0)})
            at += 4 + size
        points.append(seek)
        after.append(at)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    pcm = lambda x: (x + 128).astype(np.uint8).tobytes()
    # A full seek table gives all frames at once; other streams go on from the end of the frame before.
    full = [p is not None and p and p[0][:2] == (0, 0) and all(a[0] + a[2] == b for a, b in zip(p, [*[q[0] for q in p[1:]], t], strict=True)) for p, t in zip(points, total, strict=True)]
    turn = []
    for i, ok in enumerate(full):
        first, stop = int(base[i]) + after[i], int(base[i + 1])
        if ok:
            starts = [first + byte for _, byte, _ in points[i]]
            turn += [(i, p[0], a, b) for p, a, b in zip(points[i], starts, [*starts[1:], stop], strict=True)]
        elif total[i]:
            turn.append((i, 0, first, stop))
    while turn:
        following = []
        for k in range(0, len(turn), RUN):
            run = turn[k : k + RUN]
            lo, hi = min(t[2] for t in run), max(t[3] for t in run)
            if hi > len(data) or any(t[2] >= t[3] for t in run):
                raise ValueError("a seek point leaves the stream")
            samples, ends = decode_frames(data[lo:hi], np.array([t[2] - lo for t in run], np.int64))
            for (i, off, _, stop), x, end in zip(run, samples, ends, strict=True):
                blocks[i].append((off, pcm(x)))
                if not full[i] and off + len(x) < total[i]:
                    following.append((i, off + len(x), lo + int(end), stop))
        turn = following
    for i, b in enumerate(blocks):
        h = hashlib.md5()
        for _, x in b:
            h.update((np.frombuffer(x, np.uint8) ^ 128).tobytes())
        if sum(len(x) for _, x in b) != total[i] or any(md5[i]) and h.digest() != md5[i]:
            raise ValueError("the samples fail their checksum")
    return blocks


def _by_size(sizes: list[int], most: int = STEP) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and media: a FLAC stream of its UTF-8 bytes, padded with 0 to a positive multiple of UNIT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _by_size(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                part = [x or b"" for x in b.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                media = encode([x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)) for x in part])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in part], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The media rows with blocks: array of sample_offset and pcm, and error: why a stream couldn't be read."""
    names = [c for c in media.columns if c not in ("blocks", "error")]
    block = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def safe(streams: list[bytes]) -> list[tuple[list, str | None]]:
        try:
            return [(x, None) for x in decode(streams)]
        except (ValueError, IndexError) as e:
            return [([], str(e))] if len(streams) == 1 else [y for s in streams for y in safe([s])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(names.index("media"))
            for lo, hi in _by_size(pc.fill_null(pc.binary_length(held), 0).to_pylist(), READ_STEP):
                found = safe([x or b"" for x in held.slice(lo, hi - lo).to_pylist()])
                blocks = pa.array([[{"sample_offset": o, "pcm": p} for o, p in x] for x, _ in found], block)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, blocks, pa.array([e for _, e in found], pa.string())], [*names, "blocks", "error"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string("blocks array<struct<sample_offset: bigint, pcm: binary>>, error string")
    return media.select(*names).mapInArrow(run, StructType([*media.select(*names).schema, *extra]))


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the read-back bytes and the stored form of each row amount to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                sha, size, tail, low, high, total, energy, crossings, sign = hashlib.sha256(), 0, b"", 127, -128, 0, 0, 0, None
                pieces = b.column(3).slice(i, 1).flatten().field("pcm")
                for p in (x.as_py() for x in pieces):
                    x = np.frombuffer(p, np.uint8).astype(np.int64) - 128
                    sha.update(p)
                    size, tail = size + len(p), (tail + p)[-UNIT:]
                    if len(x):
                        low, high, total, energy = min(low, int(x.min())), max(high, int(x.max())), total + int(x.sum()), energy + int((x * x).sum())
                        below = x < 0
                        crossings += int((below[1:] != below[:-1]).sum()) + int(sign is not None and sign != below[0])
                        sign = below[-1]
                media = b.column(2)[i].as_py() or b""
                feature = f"blocks={len(pieces)};min={low};max={high};sum={total};energy={energy};crossings={crossings}"
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), b.column(4)], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    kind = decoded.schema[key].dataType.simpleString()
    return decoded.select(key, "n_bytes", "media", "blocks", "error").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op5_flac(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(decode_media(encode_media(docs)))
