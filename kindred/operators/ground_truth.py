"""What scores can be held against: common substrings, and filters of known overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel, score
from ..functions import tables as t


def longest_common_substring(a: bytes, b: bytes) -> int:
    """Length of the longest run of bytes that stands in both.

    All runs of 1, 2, 4, ... bytes are numbered, equal ones alike, each by the numbers of its
    two halves, as long as both texts have one in common. Runs of any length in between are pairs of two
    that overlap, so the length is then found by bisection. That takes about twice log2 of
    the result sortings of all places, and some 80 bytes of memory for each byte of both texts.
    """
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return len(a)
    size, own, other = 1, np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if not np.isin(own, other).any():
        return 0

    def pairs(step: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Two runs of `size` bytes, one `step` bytes behind the other, as one number, at all places; whether a pair stands in both texts."""
        most = int(max(own.max(), other.max())) + 1
        x, y = (c[: max(0, len(c) - step)] * most + c[step:] for c in (own, other))
        return x, y, bool(len(x)) and bool(np.isin(x, y).any())

    while True:
        x, y, common = pairs(size)
        if not common:
            break
        names = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        own, other, size = names[: len(x)], names[len(x) :], 2 * size
    low, high = size, min(2 * size, len(a)) + 1  # a run of `low` bytes is common, none of `high`
    while high - low > 1:
        middle = (low + high) // 2
        if pairs(middle - size)[2]:
            low = middle
        else:
            high = middle
    return low


@F.arrow_udf(T.DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        if not (x.is_valid and y.is_valid):
            out.append(None)
            continue
        x, y = x.as_py(), y.as_py()
        least = min(len(x), len(y))
        out.append(longest_common_substring(x, y) / least if least else 0.0)
    return pa.array(out, pa.float64())


def common_ratio(a: Column, b: Column) -> Column:
    """Longest common substring of two byte columns as a share of the shorter one; null if either is."""
    return _ratio(a.cast("binary"), b.cast("binary"))


def overlap_score(overlap: float, mn: int, size: int = t.LARGE_BYTES, seed: int = 0) -> int:
    """Score of two filters of `size` bytes whose elements, bits / `mn` of them each, share a part.

    The experiment that the cut-offs of large filters come from.
    """
    n = size * 8 // mn
    shared = int(n * overlap)
    words = lambda i: kernel.positions(hashlib.sha1(f"{seed}:{i}".encode()).digest())
    sides = [kernel.Filter(size), kernel.Filter(size)]
    for side, start in ((0, 0), (1, n - shared)):
        for i in range(start, start + n):
            sides[side].add(words(i))
            sides[side].count += 1
    a, b = (np.frombuffer(bytes(f.bits), "<u8") for f in sides)
    return score.large_filter_score(a, n, b, n)
