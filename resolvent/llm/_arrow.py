"""Vectorised byte-level helpers shared by the operators that run inside ``mapInArrow``.

Texts arrive as Arrow string columns; everything here works on the column's UTF-8 buffer and
offsets, so no Python object is made per document or per word.  Work is done in pieces of about
a megabyte, which bounds memory by the piece or by the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

#: ASCII lower-casing of single bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE):
    """Ranges of consecutive documents with at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def runs(kind: np.ndarray, off: np.ndarray, single: int | None = None):
    """Maximal runs of one non-zero byte class that do not cross document offsets.

    Returns (starts, ends, classes, first) where ``first`` (len(off) entries) says at which run each
    document begins.  Bytes of class ``single`` are runs of their own.
    """
    n = len(kind)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[off] = True
    if single is not None:
        cut[:n] |= kind == single
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    kinds = kind[starts]
    keep = kinds != 0
    starts, ends, kinds = starts[keep], ends[keep], kinds[keep]
    return starts, ends, kinds, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place where possible."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def padded(buf: np.ndarray) -> np.ndarray:
    """A copy with 40 zero bytes behind, so that eight bytes can be read at every position."""
    out = np.zeros(len(buf) + 40, np.uint8)
    out[: len(buf)] = buf
    return out


def words64(pad: np.ndarray) -> np.ndarray:
    """View of the little-endian 8-byte words that begin at each position."""
    return np.lib.stride_tricks.as_strided(pad[:8].view("<u8"), shape=(len(pad) - 7,), strides=(1,))


def hash_spans(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span (never 0), eight bytes at a time."""
    w, size = words64(pad), ends - starts
    h = mix((w[starts] & _LOW[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
    at, k = np.flatnonzero(size > 8), 8
    while at.size:
        h[at] = mix(h[at] * np.uint64(3) ^ (w[starts[at] + k] & _LOW[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    h[h == 0] = 1
    return h


class Table:
    """Open-addressing map from non-zero uint64 hashes to int32, in numpy arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where absent."""
        mask = (1 << self.bits) - 1
        i = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[i]
        out = np.where(key == h, self.values[i], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        while todo.size:
            i[todo] = (i[todo] + 1) & mask
            key = self.keys[i[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.values[i[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that are not in the table."""
        if (self.n + len(h)) * 2 > len(self.keys):
            held = self.keys != 0
            old = self.keys[held], self.values[held]
            self.bits = max(self.bits + 1, int(np.ceil(np.log2(2 * (self.n + len(h)) + 1))))
            self.keys, self.values, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
            self._put(*old)
        self._put(h, np.asarray(values, np.int32))

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        self.n += len(h)
        i = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while todo.size:
            free = todo[self.keys[i[todo]] == 0]
            self.keys[i[free]] = h[free]
            won = self.keys[i[todo]] == h[todo]
            self.values[i[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            i[todo] = (i[todo] + 1) & mask


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte span, as the published algorithm defines it."""
    w, size, s = words64(pad), ends - starts, np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + _P5, np.uint64)
        at, p = np.flatnonzero(size >= 32), starts.copy()
        if at.size:
            v = [np.full(at.size, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            left, live = size[at] // 32, np.arange(at.size)
            while live.size:
                q = p[at[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], w[q + 8 * k])
                p[at[live]] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            a = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                a = (a ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            h[at] = a
        h += size.astype(np.uint64)
        for k in range(3):
            live = np.flatnonzero(ends - p >= 8) if k == 0 else live[ends[live] - p[live] >= 8]
            if not live.size:
                break
            lane = w[p[live]]
            h[live] = _rot(h[live] ^ _round(np.zeros_like(lane), lane), 27) * _P1 + _P4
            p[live] += 8
        live = np.flatnonzero(ends - p >= 4)
        h[live] = _rot(h[live] ^ ((w[p[live]] & _LOW[4]) * _P1), 23) * _P2 + _P3
        p[live] += 4
        live = np.flatnonzero(ends > p)
        while live.size:
            h[live] = _rot(h[live] ^ ((w[p[live]] & _LOW[1]) * _P5), 11) * _P1
            p[live] += 1
            live = live[ends[live] > p[live]]
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h
