"""Column functions on features and filters, all evaluated by Spark itself.

A filter is an array of 64-bit words, bit b of the filter being bit b mod 64 of word
b div 64, and its number of elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t


def content(text: Column) -> Column:
    """A text as the bytes that are digested."""
    return F.encode(text, "utf-8")


def eligible(data: Column) -> Column:
    """Whether an object is large enough for a digest; null isn't."""
    return F.coalesce(F.octet_length(data) >= t.MIN_SIZE, F.lit(False))


def size_class(size: Column, limit: int = t.SMALL_OBJECT) -> Column:
    """small or large: how an object is digested by default."""
    return F.when(size < limit, F.lit("small")).otherwise(F.lit("large"))


def block_kib(size: Column, requested: int = -1, limit: int = t.SMALL_OBJECT) -> Column:
    """Block size in KiB, 0 for stream mode, from what was requested (-1: by size).

    More than 16 counts as 16, less than -1 as -1. By default, and with less than 1,
    small objects are digested as streams and large ones in blocks of 16, but 0 means
    stream for all.
    """
    asked = max(-1, min(16, requested))
    small = F.lit(asked if asked >= 1 else 0)
    large = F.lit(16 if asked == -1 else asked)
    return F.when(size < limit, small).otherwise(large).cast("int")


def feature_words(sha1_hex: Column) -> Column:
    """The five little-endian 32-bit words of a SHA-1, given in hex."""
    byte = lambda i: F.conv(F.substring(sha1_hex, 2 * i + 1, 2), 16, 10).cast("long")
    word = lambda w: byte(4 * w) + byte(4 * w + 1) * 256 + byte(4 * w + 2) * 65536 + byte(4 * w + 3) * 16777216
    return F.array(*(word(w) for w in range(t.HASHES)))


def feature_bits(sha1_hex: Column, mask: int = t.SMALL_MASK) -> Column:
    """Bits that a feature sets in a filter with this mask."""
    return F.transform(feature_words(sha1_hex), lambda w: w.bitwiseAND(F.lit(mask).cast("long")))


def _sum(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def hamming(words: Column) -> Column:
    """Number of set bits."""
    return _sum(words)


def overlap(a: Column, b: Column) -> Column:
    """Number of bits set in both filters."""
    return _sum(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def union(a: Column, b: Column) -> Column:
    """Bits of either filter; null if their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def fold(words: Column, size: int, times: int) -> Column:
    """A filter of `size` words, halved `times` times; not below 32 words once it gets there.

    Halving lays the upper half over the lower one.
    """
    for _ in range(times):
        size //= 2
        words = F.zip_with(F.slice(words, 1, size), F.slice(words, size + 1, size), lambda x, y: x.bitwiseOR(y))
        if size == 32:
            break
    return words


def fast(words: Column) -> Column:
    """A small filter folded to 64 bytes."""
    quarter = [F.slice(words, 8 * i + 1, 8) for i in range(4)]
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
    return both(both(quarter[0], quarter[2]), both(quarter[1], quarter[3]))


def bits_per_element(size: Column, elements: Column) -> Column:
    """Bits of a filter of `size` bytes for each element."""
    return size * 8 / elements


def match_estimate(bits: int, hashes: int, s1: Column, s2: Column, common: Column) -> Column:
    """Expected number of bits common to filters with s1 and s2 elements, `common` of them in both."""
    q = F.lit(1 - 1 / bits)
    power = lambda n: F.pow(q, hashes * n)
    return F.round(bits * (1 - power(s1) - power(s2) + power(s1 + s2 - common))).cast("int")


def cutoff(s1: Column, s2: Column, fast_mode: bool = False) -> Column:
    """Common bits that filters with s1 and s2 elements must exceed; null for fewer than filters to be compared have."""
    table, bits = (t.CUTOFFS_64, 1024) if fast_mode else (t.CUTOFFS_256, 4096)
    return F.get(F.array(*map(F.lit, table)), F.floor(F.lit(bits) / (s1 + s2)).cast("int"))


def cut_overlap(a: Column, b: Column, cut: Column, fast_mode: bool = False) -> Column:
    """Common bits, or 0 where a first part has so few that the whole can't reach the cut-off."""
    parts = [(2, 4)] if fast_mode else [(8, 4), (4, 8), (2, 16)]
    few = F.lit(False)
    for factor, words in parts:
        few = few | (factor * overlap(F.slice(a, 1, words), F.slice(b, 1, words)) + t.SLACK < cut)
    return F.when((cut > 0) & few, 0).otherwise(overlap(a, b))


def filter_score(a: Column, s1: Column, b: Column, s2: Column, fast_mode: bool = False) -> Column:
    """Similarity of two filters, 0 to 1; filters with fewer than 16 elements have 0."""
    cut = cutoff(s1, s2, fast_mode)
    match = cut_overlap(a, b, cut, fast_mode)
    most = F.least(hamming(a), hamming(b))
    score = F.when(match <= cut, 0.0).otherwise((match - cut) / (most - cut))
    return F.when((s1 < t.MIN_ELEMENTS) | (s2 < t.MIN_ELEMENTS), 0.0).otherwise(score)


def score_text(score: Column) -> Column:
    """A score in three digits, but -1 as it is."""
    return F.when(score == -1, F.lit("-1")).otherwise(F.lpad(score.cast("string"), 3, "0"))


def human_size(size: Column) -> Column:
    """Bytes in whole KB, MB or GB."""
    whole = lambda n: F.floor(size / n).cast("long").cast("string")
    return (
        F.when(size > 1 << 30, F.concat(whole(1 << 30), F.lit("G")))
        .when(size > 1 << 20, F.concat(whole(1 << 20), F.lit("M")))
        .otherwise(F.concat(whole(1 << 10), F.lit("K")))
    )


def short_path(path: Column, limit: int = 50) -> Column:
    """A path of more than `limit` characters by its end."""
    return F.when(F.length(path) > limit, F.concat(F.lit("..."), F.substring(path, -limit, limit))).otherwise(path)
