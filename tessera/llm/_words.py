"""Vectorised word splitting and hashing over Arrow text columns.

Everything here works on the UTF-8 bytes of a whole Arrow column, a slice of
documents at a time, so that no Python code runs per word.  A word is a maximal
run of bytes other than the six ASCII white-space bytes, which for UTF-8 is the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at once; a longer document is handled alone and whole.
SLICE_BYTES = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(1, 257, dtype=np.uint64)
_weights = mix64(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)


def _position_weights(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = mix64(np.arange(1 << int(n - 1).bit_length(), dtype=np.uint64)) | np.uint64(1)
    return _weights


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its ``len + 1`` offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` documents and ``limit`` bytes together, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, i + most, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of documents ``i..j`` of a text column.

    ``start``/``end`` are byte ranges in ``buf``; ``first`` has for each document
    the index of its first word, and the number of words at its end.  ``bytes_as``
    replaces bytes before words are taken.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False, bytes_as: np.ndarray | None = None):
        base = offsets[i]
        buf = data[base : offsets[j]]
        self.buf = bytes_as[buf] if bytes_as is not None else LOWER[buf] if lower else buf
        self.docs = offsets[i : j + 1] - base
        solid = ~SPACE[self.buf]
        self.solid = solid
        n = len(buf)
        opens = solid.copy()
        closes = solid.copy()
        if n:
            opens[1:] &= ~solid[:-1]
            closes[:-1] &= ~solid[1:]
            full = self.docs[:-1] < self.docs[1:]
            a, b = self.docs[:-1][full], self.docs[1:][full] - 1
            opens[a] = solid[a]
            closes[b] = solid[b]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.docs)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        # each byte's place in its word: 1, 1, ... with a step back at each word's first
        place = np.ones(int(size.sum()), dtype=np.int32)
        place[0] = 0
        place[at[1:]] = 1 - size[:-1]
        np.cumsum(place, out=place)
        value = _position_weights(int(size.max()))[place]
        value *= _BYTES[self.buf[self.solid]]
        return mix64(np.add.reduceat(value, at) + size.astype(np.uint64))

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words (at index of the first word) and whether a run stays in its document."""
        n = len(h)
        inside = np.zeros(n, dtype=bool)
        if n < k:
            return np.zeros(n, np.uint64), inside
        g = np.zeros(n - k + 1, np.uint64)
        for a in range(k):
            g *= _GOLD
            g += h[a : n - k + 1 + a]
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix64(g)
        left = np.repeat(self.first[1:], self.count) - np.arange(n)
        return out, left >= k

    def texts(self, d: int) -> list[bytes]:
        """The words of the ``d``-th document of this slice."""
        return self.buf[self.docs[d] : self.docs[d + 1]].tobytes().split()
