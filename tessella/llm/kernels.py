"""Vectorised text kernels over Arrow string buffers.

All functions work on a run of whole documents: `data`, the concatenated UTF-8
bytes, and `off`, the documents' offsets in it (len = documents + 1). Hashes
are 64-bit polynomials (mod 2^64, odd base) taken from prefix sums, so the hash
of any span costs two look-ups, followed by a bijective finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The bytes that end a word (space and \t \n \v \f \r).
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BYTE_BASE = 0xD6E8FEB86659FD93
WORD_BASE = 0xA0761D6478BD642F
CHUNK = 1 << 20
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 4096)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of the same values."""
    return mix(x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))


class Prefix:
    """Prefix sums from which the hash of any span [i, j) is read."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        p, self.inverse = powers(base, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:n], out=self.sums[1:])

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.inverse[i])

    def windows(self, length: int) -> np.ndarray:
        """Of every window of this length, also those across documents."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


@dataclass
class Words:
    start: np.ndarray  # byte offsets
    end: np.ndarray
    doc: np.ndarray  # index of the document
    first: np.ndarray  # per document, index of its first word; one more at the end
    hash: np.ndarray


def bounds(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay inside one document."""
    n = len(flag)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    at = off[:-1]
    before[at[at < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    at = off[1:] - 1
    after[at[at >= 0]] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, seq: Prefix | None = None) -> Words:
    """The maximal runs of non-blank bytes; lower folds A-Z before hashing. seq: the bytes' prefix sums, if they are there already."""
    start, end = bounds(IS_WORD[data], off)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, first, (seq or Prefix(LOWER[data] if lower else data, BYTE_BASE)).spans(start, end))


def whole_windows(first: np.ndarray, length: int) -> np.ndarray:
    """For every start whether its window lies in one document (first: the documents' offsets in units)."""
    n = int(first[-1])
    edge = np.zeros(n + 1, np.int8)
    a = first[:-1]
    b = np.maximum(first[1:] - length + 1, a)
    some = b > a
    edge[a[some]] += 1  # starts of long enough documents are distinct, and so are their ends
    edge[b[some]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def inside(first: np.ndarray, length: int) -> np.ndarray:
    """Window starts i for which i .. i+length-1 lie in one document."""
    return np.flatnonzero(whole_windows(first, length))


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    width = 1
    while 2 * width <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return np.minimum(a[: len(a) - (w - width)], a[w - width :]) if width < w else a


def minimizers(h: np.ndarray, first: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined anchors: (their places, the least gram of every window, which windows are whole).

    h: hashes of the k-unit grams at every start. Every window of `length` units
    inside one document holds at least one anchor gram, the least of its grams;
    equal windows hold equal anchors at equal places.
    """
    w = length - k + 1
    ok = whole_windows(first, length)[: max(len(h) - w + 1, 0)]
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), ok
    least = slide_min(h, w)
    # a gram is an anchor if it is the least of some whole window that holds it
    reach = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    np.copyto(reach[w - 1 : w - 1 + len(least)], least, where=ok)
    most = slide_max(reach, w)
    return np.flatnonzero((most == h) & (most > 0)), least, ok


def slide_max(a: np.ndarray, w: int) -> np.ndarray:
    """Maximum of each w consecutive values."""
    width = 1
    while 2 * width <= w:
        a = np.maximum(a[:-width], a[width:])
        width *= 2
    return np.maximum(a[: len(a) - (w - width)], a[w - width :]) if width < w else a


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, held = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data, off


def runs(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes together, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, bytes, offsets from 0) of each run of a column, chunk by chunk."""
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, off = column_bytes(chunk)
        for i, j in runs(off, most):
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        base += len(chunk)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n units lie in a window [start, start + length)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
