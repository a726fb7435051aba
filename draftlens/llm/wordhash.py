"""Vectorised word splitting and hashing over a buffer that holds many texts.

A batch of texts is one byte array with the offsets of its documents. Words are hashed eight bytes at a time, all words
at once, by a mixing that is one-to-one in each eight bytes, so that no family of words collides. Hashes of windows of
words come from prefix sums modulo 2**64; they are for choosing (minimisers), not for telling windows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers (fixed values; any odd numbers with well spread bits do).
SIZE_MULTIPLIER = 0x9E3779B97F4A7C15
WINDOW_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Bytes of text that are worked on at a time; temporaries take some 40 times that.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside words of letters, digits and anything beyond ASCII.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x41] = NOT_ALNUM[0x5B:0x61] = NOT_ALNUM[0x7B:0x80] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(b)
            np.multiply.accumulate(p, out=p)
            out.append(p)
        have = _powers[base] = (out[0], out[1])
        if size > 1 << 24:  # one very long text; do not keep its tables
            _powers.pop(base)
    return have[0][:n], have[1][:n]


#: Words of more bytes are hashed one at a time.
LONG_WORD = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of buf that begin at start."""
    data = np.zeros(len(buf) + 8, dtype=np.uint8)
    data[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=data, strides=(1,))  # the eight bytes from each byte on
    out = mix(size.astype(np.uint64) * np.uint64(SIZE_MULTIPLIER))
    rows = np.flatnonzero(size <= LONG_WORD)
    at, left = start[rows], size[rows]
    while len(rows):
        out[rows] = mix(out[rows] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] ^= np.uint64(xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]].tobytes()))
    return out


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


class Words:
    """Words of several texts: start and end (bytes), document index, hash, and the first word of each document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = False, hashes: bool = True):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = ~breaks[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # of document d: first[d] .. first[d + 1]
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        if hashes:
            self.read = _LOWER[buf] if lower else buf
            self.hash = word_hashes(self.read, self.start, self.end - self.start)

    def stems(self, most: int) -> np.ndarray:
        """Hashes of the words' first bytes, at most so many."""
        return word_hashes(self.read, self.start, np.minimum(self.end - self.start, most))

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hashes of all runs of size words, also of those that cross documents (see inside()). Different runs may share one."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        base = WINDOW_MULTIPLIERS[which]
        sums = prefix(mix(self.hash + np.uint64(which)), base)
        return mix((sums[size:] - sums[:n]) * powers(base, n)[1] + np.uint64(which))

    def inside(self, size: int) -> np.ndarray:
        """Positions of the windows of size words that lie in one document."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about most bytes: (first row, end row, bytes, offsets). Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        to = min(to, len(column))
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
