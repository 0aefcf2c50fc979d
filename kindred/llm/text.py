"""Vectorised text primitives: words, hashes and windows of whole Arrow batches.

Texts of a batch are handled as one byte array with document offsets, so the
cost per byte is a few numpy passes and no Python object is made per word.
Hashes are 64 bits wide; operators that need exactness compare the texts too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of text that are handled in one numpy pass.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, lower-case ASCII letters and all of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words that white space ends.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[9:14] = VISIBLE[32] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    factor = base & (1 << 64) - 1
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(factor)])
        factor = factor * factor & (1 << 64) - 1
    return out[:n]


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _tables(SLICE_BYTES + (1 << 16) if n <= SLICE_BYTES + (1 << 16) else size)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return body, at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `size` bytes; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


class Words:
    """Words of some documents.

    start, end: byte range of each word; first: index of each document's first
    word, with the number of all words as last entry; code: hash of each word.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, member: np.ndarray = ALNUM, lower: bool = True):
        low = LOWER[body] if lower else body
        inside = member[low]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cut = offsets[(offsets > 0) & (offsets < len(inside))]
            before[cut] = False
            after[cut - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.low = low
        power, inverse = powers(len(low))
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[low] * power[: len(low)], out=total[1:])
        self.code = mix((total[self.end] - total[self.start]) * inverse[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """Row of each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the index of each document's first.

        With `short`, a document of fewer words, but not none, has one window of
        all its words.
        """
        n = len(self.code)
        counts = np.diff(self.first)
        full = np.maximum(counts - k + 1, 0)
        ends = np.cumsum(full)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
        if n >= k and len(out):
            run = np.zeros(n - k + 1, dtype=np.uint64)
            for i in range(k):
                run *= _STEP
                run += self.code[i : n - k + 1 + i]
            at = np.arange(len(out)) + np.repeat(self.first[:-1] - (ends - full), full)
            out = mix(run[at])
        first = np.concatenate([[0], ends])
        few = np.flatnonzero((counts > 0) & (counts < k)) if short else []
        if len(few):
            extra = np.array([self._whole(d) for d in few], dtype=np.uint64)
            out = np.insert(out, first[few], extra)
            sizes = full.copy()
            sizes[few] = 1
            first = np.concatenate([[0], np.cumsum(sizes)])
        return out, first

    def _whole(self, d: int) -> np.uint64:
        run = np.zeros(1, dtype=np.uint64)
        for code in self.code[self.first[d] : self.first[d + 1]]:
            run *= _STEP
            run += code
        return mix(run)[0]


def text_words(column: pa.Array, member: np.ndarray = ALNUM, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Words of a string column, a slice of rows at a time."""
    body, offsets = column_bytes(column)
    for a, b in slices(offsets):
        yield a, b, Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], member, lower)


def hash_range(codes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hash values each one lies in."""
    return ((codes >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)
