"""Line dedup over a whole corpus by a deletion-neighbourhood join.

A line goes if an earlier line equals it or is one character edit away (one
character inserted, deleted or replaced). Equal lines meet by a 128-bit hash,
aggregated before the shuffle. For the rest, lines emit the variants that one
deletion leaves as hashed keys; lines with equal variants are verified by edit
distance.

Emitting each variant of each line would multiply the corpus by the length of its
lines. So deletions are emitted coarse to fine: first with one half left out, then
one eighth, then one character; only lines that meet another at one level emit the
next, and only inside the part that was left out. Lines one edit apart agree
outside some half and some eighth, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import written, key_id, likely, row_key, split
from .text import column_bytes, mix, powers, slices

_U = np.uint64


class _Characters:
    """Prefix sums over the characters of some texts, for O(1) hashes of any part."""

    def __init__(self, text: str):
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.point = point
        self.power, self.inverse = powers(len(point) + 1)
        self.sums = self._sums(mix(point.astype(_U) + _U(0x51ED2701)))

    def _sums(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code) + 1, dtype=_U)
        np.cumsum(code * self.power[: len(code)], out=out[1:])
        return out

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def without(self, a, b, cut_a, cut_b) -> np.ndarray:
        """Hash of [a, b) with [cut_a, cut_b) left out."""
        return self.part(a, cut_a) + self.part(cut_b, b) * self.power[cut_a - a]

    def second(self) -> np.ndarray:
        return self._sums(mix(self.point.astype(_U) + _U(0x2545F4914F6CDD1D)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _block_keys(chars: _Characters, start: np.ndarray, end: np.ndarray, blocks: int) -> list[tuple[int, int, np.ndarray]]:
    """(whether as the longer line, block, key) of the lines [start, end).

    A key is what is left without one of `blocks` parts. Lines of L and of L + 1
    characters are cut at the same places of L, the longer one's part having one
    character more; so each line has keys as the one and as the other.
    """
    out = []
    for longer in (0, 1):
        n = end - start - longer
        for i in range(blocks):
            a, b = start + i * n // blocks, start + (i + 1) * n // blocks + longer
            key = mix(chars.without(start, end, a, b) + n.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(blocks * 64 + i))
            out.append((longer, i, key))
    return out


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = column_bytes(batch.column(1))
        for a, b in slices(offsets):
            yield from _slice_lines(batch.column(0).slice(a, b - a), body[offsets[a] : offsets[b]].tobytes().decode("utf-8", "replace"), batch.column(1).slice(a, b - a), min_chars)


def _slice_lines(ids: pa.Array, text: str, column: pa.Array, min_chars: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    chars = _Characters(text)
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    # line ends: line feeds, and the ends of documents with a text
    breaks = np.flatnonzero(chars.point == 10)
    there = np.asarray(pc.is_valid(column))
    end = np.concatenate([breaks, ends[there]])
    start_doc = ends - sizes
    document = np.concatenate([np.searchsorted(ends, breaks, "right"), np.flatnonzero(there)])
    order = np.lexsort((end, document))
    end, document = end[order], document[order]
    if not len(end):
        return
    start = np.empty_like(end)
    start[0] = start_doc[document[0]]
    same = document[1:] == document[:-1]
    start[1:] = np.where(same, end[:-1] + 1, start_doc[document[1:]])
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    number = np.arange(len(end)) - np.repeat(begin, np.diff(np.append(begin, len(end))))
    # lines with something but white space
    dark = np.concatenate([[0], np.cumsum(~((chars.point == 32) | ((chars.point >= 9) & (chars.point <= 13)) | (chars.point == 160)))])
    keep = dark[end] > dark[start]
    start, end, document, number = start[keep], end[keep], document[keep], number[keep]
    h1 = mix(chars.part(start, end) + (end - start).astype(_U))
    sums = chars.second()
    h2 = mix((sums[end] - sums[start]) * chars.inverse[start])
    order = np.lexsort((number, h2, h1, document))
    first = np.ones(len(order), dtype=bool)
    o = order
    first[1:] = (h1[o[1:]] != h1[o[:-1]]) | (h2[o[1:]] != h2[o[:-1]]) | (document[o[1:]] != document[o[:-1]])
    again = np.zeros(len(order), dtype=bool)
    again[o[~first]] = True
    keys = [np.where(end - start >= min_chars, key.view(np.int64), 0) for _, _, key in _block_keys(chars, start, end, 2)]
    yield pa.RecordBatch.from_arrays(
        [ids.take(pa.array(document)), pa.array(number.astype(np.int32)), _signed(h1), _signed(h2), pa.array(again), pa.array((end - start >= min_chars) & ~again), *(pa.array(k) for k in keys)],
        names=["doc", "line", "h1", "h2", "again", "fuzzy", "k0", "k1", "k2", "k3"],
    )


_DOC = "doc struct<n: boolean, id: bigint, t: bigint>"
_LINES = f"{_DOC}, line int, h1 long, h2 long, again boolean, fuzzy boolean, k0 long, k1 long, k2 long, k3 long"


def _eighths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of lines without one eighth."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        if not texts:
            continue
        chars = _Characters("".join(texts))
        size = np.array([len(t) for t in texts], dtype=np.int64)
        end = np.cumsum(size)
        for longer, i, key in _block_keys(chars, end - size, end, 8):
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(n, longer, np.int32)), pa.array(np.full(n, i, np.int32)), _signed(key)],
                names=["doc", "line", "longer", "block", "key"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One-deletion variants inside the eighth that was left out.

    kind 0: the variant with the place of the deletion, for replaced characters;
    kind 1: the variant alone, which equals a line that is shorter by one; kind 2:
    the line itself, as that shorter one.
    """
    for batch in batches:
        doc, line, text, longer, block = (batch.column(i) for i in range(5))
        texts = text.to_pylist()
        if not texts:
            continue
        chars = _Characters("".join(texts))
        size = np.array([len(t) for t in texts], dtype=np.int64)
        end = np.cumsum(size)
        start = end - size
        more = longer.to_numpy(zero_copy_only=False).astype(np.int64)
        i = block.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size - more
        a, b = i * n // 8, (i + 1) * n // 8 + more
        row = np.repeat(np.arange(len(texts)), b - a)
        at = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]
        left = chars.without(start[row], end[row], start[row] + at, start[row] + at + 1)
        kind = more[row]
        salt = np.where(kind == 0, (at + 1).astype(_U) * _U(0xD1B54A32D192ED03), _U(1))
        key = mix(left + size[row].astype(_U) * _U(0x9E3779B97F4A7C15) + salt)
        whole = np.flatnonzero(more == 0)
        own = mix(chars.part(start[whole], end[whole]) + (size[whole] + 1).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))
        rows = pa.array(np.concatenate([row, whole]))
        yield pa.RecordBatch.from_arrays(
            [doc.take(rows), line.take(rows), pa.array(np.concatenate([kind, np.full(len(whole), 2)]).astype(np.int32)), _signed(np.concatenate([key, own]))],
            names=["doc", "line", "kind", "key"],
        )


def _edit(a: str, b: str) -> bool:
    """Whether at most one edit makes a to b: they agree up to some place, and behind it."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    at = int(differ[0]) if len(differ) else len(x)
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines within one edit of another."""
    for batch in batches:
        good = [_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["doc", "line"]).filter(pa.array(good, pa.bool_()))


def _marked(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc, line) of every line that an earlier one makes superfluous; rows: (doc, text)."""
    lines = rows.mapInArrow(lambda batches: _lines(batches, min_chars), _LINES)
    lines = written(lines)
    once = lines.where(~F.col("again"))
    # the first document of equal lines; within a document `again` has marked the others
    first = once.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    # cut off, so that the join has an exchange on both sides and Spark can split a line that is everywhere
    repeated = written(first.where("n > 1"))
    several = once.select("doc", "line", "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
    equal = lines.where("again").select("doc", "line").union(several.select("doc", "line"))
    equal = written(equal.distinct())
    fuzzy = once.where("fuzzy").select("doc", "line", "k0", "k1", "k2", "k3").join(equal, ["doc", "line"], "left_anti")
    keys = fuzzy.select("doc", "line", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    met = _meeting(keys)
    near = keys.join(met, "key", "left_semi").select("doc", "line").distinct()
    near = written(near.groupBy("doc").agg(F.collect_list("line").alias("lines")))
    texts = likely(rows, near, "doc").join(near, "doc").select("doc", F.explode("lines").alias("line"), F.get(F.split("text", "\n"), F.col("line")).alias("text")).where("text is not null")
    texts = written(texts.dropDuplicates(["doc", "line"]))
    eighths = texts.mapInArrow(_eighths, f"{_DOC}, line int, longer int, block int, key long")
    hits = eighths.join(_meeting(eighths.select("doc", "line", "key")), "key", "left_semi").select("doc", "line", "longer", "block")
    variants = texts.join(hits, ["doc", "line"]).select("doc", "line", "text", "longer", "block").mapInArrow(_variants, f"{_DOC}, line int, kind int, key long")
    variants = written(variants)
    place = F.struct("doc", "line")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, place))
    groups = variants.groupBy("key").agg(least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2"), F.count("*").alias("n")).where("n > 1")
    other = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.join(groups, "key").select("doc", "line", other.alias("o")).where(F.col("o") < place)
    pairs = pairs.select("doc", "line", F.col("o.doc").alias("other"), F.col("o.line").alias("other_line")).distinct()
    one = texts.select(F.col("doc").alias("other"), F.col("line").alias("other_line"), F.col("text").alias("other_text"))
    both = pairs.join(texts, ["doc", "line"]).join(one, ["other", "other_line"]).select("doc", "line", "text", "other_text")
    return equal.union(both.mapInArrow(_verified, f"{_DOC}, line int")).distinct()


def _meeting(keys: DataFrame) -> DataFrame:
    """Keys that more than one line has."""
    place = F.xxhash64("doc", "line")
    return keys.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))


def _by_row(lines: DataFrame) -> DataFrame:
    """(doc, dropped): the dropped lines of each row in order."""
    return lines.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("dropped"))


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, text_key, line) of every line that an earlier one makes superfluous.

    Lines are what line feeds separate, numbered from 0; earlier means a smaller
    (row, line). Rows are in order of their id, null ids last; of rows with one id, or
    none, the order is that of text_key, 60 bits of the text's MD5 hash. Each such row
    stands for itself; rows with equal id and text are one, with the same lines. A line
    goes if an earlier line of the table equals it, or, for lines of at least
    `min_chars` characters, is within one edit of it. Blank lines stay. Null and empty
    texts and empty tables have no such lines, a line or text may have any length, and
    other columns don't matter.
    """
    found = _marked(_rows(docs, id_col, text_col), min_chars)
    return found.select(key_id("doc").alias("doc_id"), F.col("doc.t").alias("text_key"), "line")


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Per row: its lines, how many go, and which, comma-joined.

    Rows as for `duplicate_lines`; a null text has no lines, a repeated row the same
    report as often as it stands, and an empty table gives no rows.
    """
    dropped = _by_row(_marked(_rows(docs, id_col, text_col), min_chars))
    text = F.col(text_col).cast("string")
    sizes = docs.select(row_key(id_col, text_col).alias("doc"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("lines"))
    sizes = sizes.select("doc", F.when(F.col("lines") < 0, 0).otherwise(F.col("lines")).cast("long").alias("n_lines"))
    return sizes.join(dropped, "doc", "left").select(
        key_id("doc").alias("doc_id"),
        "n_lines",
        F.coalesce(F.size(F.coalesce("dropped", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"),
    )


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """`docs` without its duplicate lines, all columns kept; rows as for `duplicate_lines`.

    Texts that lose no line stay as they are, and aren't shuffled. A document all of
    whose lines go is left with an empty text.
    """
    dropped = written(_by_row(_marked(_rows(docs, id_col, text_col), min_chars)).select(F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped")))
    some, others = split(docs.withColumn("__doc", row_key(id_col, text_col)), dropped, "__doc")
    joined = some.join(dropped, "__doc", "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns)).unionByName(others.select(*docs.columns))
