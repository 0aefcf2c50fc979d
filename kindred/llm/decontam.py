"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items, texts the words of documents.
A table gives for each block of two words how far the search may jump, so most
positions are never looked at; where the jump is zero, the bucket of that suffix
block and the hash of the whole window name the pattern to test, and a direct
comparison of bytes confirms. Many stretches of text are searched side by side as
lanes of numpy arrays, and all their hits are confirmed in one pass.

Patterns travel to the tasks in chunks of a bounded number of windows, made one
after the other; a task searches a batch of texts with one chunk after the other,
so that neither the driver nor a task holds more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Words, mix, text_words

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words of text in a lane; bytes that are compared in one pass; log2 of the entries of a jump table, at most.
LANE, COMPARED, TABLE_BITS = 256, 16 << 20, 24


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for `size[i]` places, one run behind the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space behind each, and where each begins and ends."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, dtype=np.uint8)
    out[_runs(end - size, size)] = words.low[_runs(words.start, size)]
    return out, end - size, end


def _hashes(code: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m codes from each one on."""
    n = max(0, len(code) - m + 1)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(m):
        run = run * np.uint64(0xD6E8FEB86659FD93) + code[i : n + i]
    return mix(run)


class WuManber:
    """Search machine for the distinct windows of `m` words each of some items.

    words: of the items, item by item; item: number of each one; windows of another
    length than m, of items that are too short, are other machines' business.
    """

    def __init__(self, words: Words, item: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        self.text, start, end = _joined(words)
        counts = np.diff(words.first)
        begin = _runs(words.first[:-1], np.maximum(counts - m + 1, 0))
        who = np.repeat(item, np.maximum(counts - m + 1, 0))
        # equal windows are one pattern: 128 bits of hashes
        one, two = _hashes(words.code, m)[begin], _hashes(mix(words.code + np.uint64(7)), m)[begin]
        order = np.lexsort((who, two, one))
        begin, who, one, two = begin[order], who[order], one[order], two[order]
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = new.copy()
        fresh[1:] |= who[1:] != who[:-1]
        pattern = np.cumsum(new) - 1
        first = begin[new]
        self.start, self.end = start[first], end[first + m - 1] if len(first) else first
        # items of each pattern
        self.items, self.offsets = who[fresh], np.searchsorted(pattern[fresh], np.arange(len(first) + 1))
        blocks = self._blocks(words.code)
        self.bits = min(TABLE_BITS, max(12, int(len(first) * m * 4).bit_length()))
        self.shift = np.full(1 << self.bits, min(m - self.block + 1, 127), dtype=np.int8)
        for i in range(m - self.block + 1):
            np.minimum.at(self.shift, self._slot(blocks[first + i]), min(m - self.block - i, 127))
        # buckets of the suffix block, in each the patterns by the hash of the whole
        key = self._key(blocks[first + m - self.block], one[new]) if len(first) else np.zeros(0, np.uint64)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _blocks(self, code: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return code
        return mix(code[:-1] * np.uint64(3) + code[1:])

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def _key(self, suffix: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (suffix & np.uint64(0xFFFFFFFF00000000)) | (whole >> np.uint64(32))

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences, in no special order."""
        none = np.zeros(0, np.int64)
        counts = np.diff(words.first)
        if not len(self.keys) or len(words) < self.m:
            return none, none
        block = self._blocks(words.code)  # block ending at word i + block - 1
        jump = self.shift[self._slot(block)].astype(np.int64)
        # lanes: places where a pattern's last word may stand, document by document
        lanes = np.maximum(0, -(-(counts - self.m + 1) // LANE))
        nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(words.first[:-1] + self.m - 1, lanes) + nth * LANE
        stop = np.minimum(np.repeat(words.first[1:], lanes), at + LANE)
        found = []
        while len(at):
            step = jump[at - self.block + 1]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step = np.maximum(step, 1)
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        begin = np.concatenate(found) - self.m + 1
        key = self._key(block[begin + self.m - self.block], _hashes(words.code, self.m)[begin])
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        candidates = _runs(low, high - low)
        begin, pattern = np.repeat(begin, high - low), self.order[candidates]
        text, start, end = _joined(words)
        a, size = start[begin], end[begin + self.m - 1] - start[begin]
        b = self.start[pattern]
        same = size == self.end[pattern] - b
        begin, pattern, a, b, size = begin[same], pattern[same], a[same], b[same], size[same]
        good = np.ones(len(begin), dtype=bool)
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), COMPARED)[1:]) if len(size) else []
        for part in np.split(np.arange(len(begin)), cuts):
            differ = text[_runs(a[part], size[part])] != self.text[_runs(b[part], size[part])]
            good[part] = np.bincount(np.repeat(np.arange(len(part)), size[part])[differ], minlength=len(part)) == 0
        return begin[good], pattern[good]

    def of_items(self, row: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, item) of rows in which patterns occur."""
        size = self.offsets[pattern + 1] - self.offsets[pattern]
        pair = np.unique(np.repeat(row, size) * np.int64(1 << 31) + self.items[_runs(self.offsets[pattern], size)])
        return pair >> 31, pair & ((1 << 31) - 1)


def machines(items: list[tuple[str, str | None]], window: int) -> tuple[np.ndarray, list[WuManber]]:
    """The items' names, and one machine for each length of pattern that they give."""
    names = np.array([i for i, _ in items], dtype=object)
    body = [(t or "").encode() for _, t in items]
    whole = Words(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]))
    length = np.minimum(np.diff(whole.first), window)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == m)
        part = [body[i] for i in rows]
        out.append(WuManber(Words(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])), rows, m))
    return names, out


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[tuple[np.ndarray, list[WuManber]]]:
    """Machines of at most about `most` patterns each, in order of the items' rows."""
    items, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if item is None:
            continue
        items.append((item, text))
        size += max(1, len(text or "") // 2)
        if size >= most:
            yield machines(items, window)
            items, size = [], 0
    if items:
        yield machines(items, window)


def _sent(spark: SparkSession, chunks: Iterator) -> list[Broadcast]:
    """The chunks as files of their own for the tasks; the driver keeps none of them in memory."""
    return [spark.sparkContext.broadcast(chunk) for chunk in chunks]


def _occurrences(chunks: list[Broadcast], words: Words) -> tuple[np.ndarray, list[set[str]], np.ndarray]:
    """Hit words as a mask, the items of each document, and how many longest windows of it are hit."""
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
    full = np.zeros(len(items), dtype=np.int64)
    for shared in chunks:
        names, parts = shared.value
        for machine in parts:
            start, pattern = machine.search(words)
            hit += np.bincount(start, minlength=len(hit)) - np.bincount(start + machine.m, minlength=len(hit))
            row = np.searchsorted(words.first, start, "right") - 1
            full = np.maximum(full, np.where(np.bincount(row, minlength=len(full)) > 0, machine.m, 0))
            for d, i in zip(*(x.tolist() for x in machine.of_items(row, pattern)), strict=True):
                items[d].add(names[i])
        if len(chunks) > 1:
            shared._value = None  # read again from its file with the next texts
    return np.cumsum(hit)[:-1] > 0, items, full


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def benchmark_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    min_items: int = 2,
    max_patterns: int = 500_000,
) -> DataFrame:
    """How much of each whole document stands in benchmark items.

    Returns per document its words, the words inside any occurrence of an item's
    window, the items that occur, their digest, and whether at least `min_items`
    items occur. An item of fewer words than a window, but not none, is one
    window. Null texts have no words; items without an id are left out, a benchmark
    without items occurs nowhere; a repeated row is judged as often as it stands, a
    null id stays null; no documents give no rows; other columns don't matter, and a
    text of any length is searched as a whole. Nothing is shuffled. A chunk has at
    most about `max_patterns` windows, some 30 bytes each and 16 MB for its table.
    """
    spark = docs.sparkSession
    chunks = _sent(spark, _chunks(benchmark, item_col, item_text_col, window, max_patterns))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in text_words(batch.column(1)):
                hit, sets, _ = _occurrences(chunks, words)
                total = np.concatenate([[0], np.cumsum(hit)])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(words.first).astype(np.int64)),
                    pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets]),
                    pa.array([len(s) >= min_items for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(run, SCHEMA)


def leaks(
    spark: SparkSession,
    benchmark: DataFrame,
    text: Column,
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    min_items: int = 2,
    max_patterns: int = 500_000,
) -> Column:
    """Whether benchmark text leaks into `text`: as a column, for filters.

    It does if any whole window of `window` words of an item occurs. A shorter item
    is too common for that; such ones count if at least `min_items` items occur.
    Null texts have none.
    """
    chunks = _sent(spark, _chunks(benchmark, item_col, item_text_col, window, max_patterns))

    @F.arrow_udf("boolean")
    def found(column: pa.Array) -> pa.Array:
        out = []
        for _, _, words in text_words(column):
            _, sets, longest = _occurrences(chunks, words)
            out += [n >= window or len(s) >= min_items for n, s in zip(longest.tolist(), sets, strict=True)]
        return pa.array(out, pa.bool_())

    return found(text.cast("string"))
