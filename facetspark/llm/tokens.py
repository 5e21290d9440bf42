"""Vectorised word finding and hashing over Arrow string columns.

The texts of a batch lie one after another in one byte buffer. Words, their 64-bit hashes
and the hashes of word windows are computed over that buffer with whole-array numpy
operations, so the cost is a few nanoseconds a byte instead of a Python step a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space [\x20\x09-\x0D] separates.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of ASCII digits, a-z and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, b in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(n + n // 4, b, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and each row's offsets into them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the rows of a column: ``starts`` and ``ends`` in ``low`` (lower-cased bytes),
    ``row`` of each, ``first`` (index of each row's first word; one more than rows), ``hash``."""

    def __init__(self, column: pa.Array, kinds: np.ndarray):
        self.raw, self.offsets = text_bytes(column)
        self.low = low = LOWER[self.raw]
        n = len(low)
        inside = kinds[low]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        p, inv = powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[low] * p[:n], out=run[1:])
        self.hash = mix((run[self.ends] - run[self.starts]) * inv[self.starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words of one row, and the index of each one's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _STEP + self.hash[j : n - k + 1 + j]
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return mix(acc[at] ^ np.uint64(k)), at

    def whole(self, row: int) -> int:
        """Hash of the row's whole word sequence, as a window of that length has."""
        acc, h = np.uint64(0), self.hash[self.first[row] : self.first[row + 1]]
        with np.errstate(over="ignore"):
            for x in h:
                acc = acc * _STEP + x
        return int(mix(np.array([acc ^ np.uint64(len(h))], np.uint64))[0])

    def phrase(self, i: int, k: int) -> bytes:
        """Words i to i+k-1, joined by a space."""
        return b" ".join(self.low[self.starts[j] : self.ends[j]].tobytes() for j in range(i, i + k))
