"""Vectorised text kernels over Arrow batches (numpy only, no Spark imports).

Every kernel works on the UTF-8 bytes of whole texts.  Texts of a batch are
taken in slices of a bounded number of bytes, so memory follows the slice and
the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 19

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_W = 0xD1342543DE82EF95 | 1
_W_INV = pow(_W, -1, 1 << 64)


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
PLAIN_WORD = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM_WORD = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


class _Powers:
    """Powers of a constant modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.n = base, inverse, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, SLICE_BYTES + 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(self.n, base, dtype=U64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_R, _R_INV), _Powers(_W, _W_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 mixer)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


class Words:
    """The words of some consecutive rows ``first .. last`` of a batch.

    ``data`` holds the rows' bytes (lower-cased if asked), ``start``/``end``
    the words' byte range in it, ``rows`` the first word of each row (one
    more entry than rows) and ``hash`` a 64-bit hash of each word.
    """

    __slots__ = ("data", "end", "first", "hash", "last", "rows", "start")

    def __init__(self, first, last, data, start, end, rows, hashes):
        self.first, self.last, self.data = first, last, data
        self.start, self.end, self.rows, self.hash = start, end, rows, hashes


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column, table: np.ndarray = PLAIN_WORD, lower: bool = False, hashes: bool = True) -> Iterator[Words]:
    """Split each row into words; a word never spans two rows."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        b = data[lo:hi]
        if lower:
            b = LOWER[b]
        cuts = offsets[i : j + 1] - lo
        inside = table[b]
        edge = np.empty(len(b) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = False
        edge[cuts] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        rows = np.searchsorted(start, cuts)
        h = None
        if hashes:
            up, down = _BYTES.upto(max(1, len(b)))
            with np.errstate(over="ignore"):
                total = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE_VALUE[b] * up[: len(b)], dtype=U64)))
                h = (total[end] - total[start]) * down[start] if len(start) else np.zeros(0, U64)
                h = mix(h + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))
        yield Words(i, j, b, start, end, rows, h)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive word hashes."""
    if len(h) < width:
        return np.zeros(0, U64)
    up, down = _WORDS.upto(len(h))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(h * up, dtype=U64)))
        return mix((total[width:] - total[:-width]) * down[: len(h) - width + 1] + U64(width))


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter sequence is one shingle, an empty one none."""
    if not len(h):
        return np.zeros(0, U64)
    return np.unique(windows(h, min(width, len(h))))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` words that lie in a window beginning at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
