"""How the sources of a language differ: exact divergences of smoothed term shares.

Terms are counted once in the tasks that read the texts, and once more by Spark. The
counts of a language are cut into blocks of terms. A task has one block with the counts of
all groups, makes of it a dense matrix of int64, a tile of terms after the other, and broadcasts
groups against groups. Sums of these partial matrices are the divergences of pairs. For terms
that stand out in a group, a block keeps each group's best, and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import written
from .text import LOWER, column_bytes, slices

#: Bytes of terms: ASCII letters and all of non-ASCII characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

#: Shares are whole numbers of billionths.
SCALE = 1_000_000_000
#: Numbers in a tile of pairs, at most, unless one pair of groups has more.
_TILE = 1 << 20


def _terms(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The document and the dictionary-encoded bytes of each term in some documents."""
    inside = np.append(LETTERS[body], False)
    first = np.zeros(len(inside), dtype=bool)
    first[offsets[:-1]] = True  # a term ends with its document
    before = np.append(False, inside[:-1]) & ~first
    start = np.flatnonzero(inside & ~before)
    size = np.diff(np.append(np.cumsum(inside)[start] - 1, int(inside.sum())))
    document = np.searchsorted(offsets, start, "right") - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    kind, index = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    packed = LOWER[body[inside[:-1]]]
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(index)), pa.py_buffer(packed)])
    return document, words.dictionary_encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each batch; a row without a term for each of its groups."""
    for batch in batches:
        if not len(batch):
            continue
        group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
        name: dict = {}
        number = np.array([name.setdefault((g["lang"], g["source"]), len(name)) for g in group.to_pylist()], dtype=np.int64)
        body, offsets = column_bytes(batch.column("text"))
        langs, sources = (pa.array([g[i] for g in name], pa.string()) for i in (0, 1))
        none = pa.array([0] * len(name), pa.int64())
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(name), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])
        for a, b in slices(offsets):
            document, words = _terms(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(words):
                continue
            size = len(words.dictionary)
            once, n = np.unique(document * size + words.indices.to_numpy(), return_counts=True)
            key, at = np.unique(number[a:b][once // size] * size + once % size, return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, at, n)
            who = pa.array(key // size)
            text = words.dictionary.take(pa.array(key % size)).cast(pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            columns = [langs.take(who), sources.take(who), text, pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, total: int | np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for totals up to 9 * 10**15."""
    whole = np.broadcast_to(np.asarray(total, dtype=np.int64) + terms, count.shape)
    if not count.size:
        return count.astype(np.int64)
    out, rest = np.divmod(count.astype(np.int64) + 1, whole)
    if int(whole.max()) >= (1 << 63) // 1000:
        raise OverflowError("more than 9 * 10**15 terms in a language")
    for _ in range(3):  # three digits at a time, so that no product overflows
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _block(top: int):
    """Partial divergences of all pairs of groups and each group's best terms, of one block of terms of a language."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        isnull = rows.column("term").is_null().to_numpy()
        groups = rows.filter(pa.array(isnull)).sort_by("number")
        names, totals = groups.column("source").to_pylist(), groups.column("total").to_numpy()
        size, vocabulary, everything = len(names), groups.column("terms")[0].as_py(), int(totals.sum())
        counts = rows.filter(pa.array(~isnull))
        coded = counts.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
        # terms in order of their bytes
        order = pa.compute.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        words = coded.dictionary.take(pa.array(order)).cast(pa.string())
        term, group, n = place[coded.indices.to_numpy()], counts.column("number").to_numpy(), counts.column("n").to_numpy()
        by = np.argsort(term, kind="stable")
        term, group, n = term[by], group[by], n[by]
        # first group of the pairs that this task has; a language of very many groups is dealt to several tasks
        low, high = int(key[2].as_py()) * _ROWS, min(size, (int(key[2].as_py()) + 1) * _ROWS)
        pairs = np.zeros((high - low, size), dtype=np.int64)
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(high - low)]
        width = max(1, _TILE // max(1, size))
        for begin in range(0, len(words), width):
            end = min(begin + width, len(words))
            i, j = np.searchsorted(term, [begin, end])
            tile = np.zeros((size, end - begin), dtype=np.int64)
            tile[group[i:j], term[i:j] - begin] = n[i:j]
            p = shares(tile, totals[:, None], vocabulary)
            q = shares(tile.sum(axis=0), everything, vocabulary)
            step = max(1, _TILE // p.size) if p.size else 1
            for a in range(low, high, step):
                own = p[a : min(a + step, high)]
                far = own[:, None, :] - p[None, :, :]
                pairs[a - low : a - low + len(own)] += (far * far // p[None, :, :]).sum(axis=2)
            far = p[low:high] - q
            value = np.where((tile[low:high] > 0) & (far > 0), far * far // q, -1)
            for a in range(high - low):
                there = np.flatnonzero(value[a] >= 0)
                there = there[np.argsort(-value[a, there], kind="stable")[:top]]
                best[a].append((value[a, there], there + begin))
        names_ = pa.array(names, pa.string())
        for a in range(high - low):
            other = np.flatnonzero(np.arange(size) != low + a)
            parts = [("pair", names_.take(pa.array(other)), pairs[a, other])]
            if best[a]:
                value, at = (np.concatenate(x) for x in zip(*best[a], strict=True))
                keep = np.lexsort((at, -value))[:top]
                parts.append(("term", words.take(pa.array(at[keep])), value[keep]))
            for part, item, value in parts:
                if len(value):
                    fixed = lambda x: pa.array([x] * len(value), pa.string())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([fixed(key[0].as_py()), fixed(names[low + a]), fixed(part), item, pa.array(value)], names=["lang", "source", "part", "item", "value"])

    return run


#: Groups whose pairs one task of a block makes.
_ROWS = 512


def audit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 3,
    top: int = 200,
    block_rows: int = 1 << 16,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and in which terms.

    A language keeps the terms that stand in `min_docs` of its documents, V of them. A group
    (language and source), and the language, give a term with c occurrences among N of kept terms the share
    1 + floor(10**9 (c + 1) / (N + V)). Part "pair" has the divergence, the sum of floor((p - q)**2 / q)
    over all kept terms, of each other source of the language; part "term" has, of terms that the
    group has and uses more than the language does, the `top` with the greatest floor((p - q)**2 / q) against the
    language's share q. Ranks begin with 1 and follow values, then the items' bytes.

    Null texts, languages and sources are empty ones, which are texts and names as any other. A group without
    terms has pairs as well; with one source there are none; an empty table gives no rows.
    Other columns don't matter. Repeated rows count as often as they stand. Texts are used as a whole.
    All numbers are exact: shares up to 9 * 10**15 terms in a language, sums in 64 bits.

    The counts of a language go to blocks by a hash of the term, of about `block_rows` counts each (four for each pair of
    sources, if that is more: sums of pairs are then fewer than counts), so no source and no term gathers rows. A language of more than 512 sources has a task for each 512 of them and block; such a
    task takes its block's counts and a matrix of 512 rows. All pairs of sources of a language
    are what is asked for, and so are rows of the result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    found = counted.where(F.col("term").isNotNull())
    common = written(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"))
    kept = written(found.join(common, ["lang", "term"]).select("lang", "source", "term", "n"))
    # groups, by number, with their terms, and the blocks of each language
    group = counted.where("term is null").select("lang", "source")
    group = group.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("counts")), ["lang", "source"], "left").na.fill(0)
    lang = group.groupBy("lang").agg(F.sum("counts").alias("counts"), F.count("*").alias("groups"))
    lang = lang.join(common.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").na.fill(0)
    size = F.greatest(F.lit(block_rows), 4 * F.col("groups") * F.col("groups"))
    lang = written(lang.select("*", F.ceil(F.greatest(F.col("counts"), F.lit(1)) / size).cast("int").alias("blocks"), F.ceil(F.col("groups") / F.lit(_ROWS)).cast("int").alias("parts")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    group = written(group.join(lang.drop("counts", "groups"), "lang").withColumn("number", number.cast("int")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    heads = group.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "number", "total", "terms", "blocks", "parts")
    heads = heads.withColumn("block", each("blocks"))
    cells = kept.join(group.select("lang", "source", "number", "blocks", "parts"), ["lang", "source"])
    cells = cells.select("lang", F.lit(None).cast("string").alias("source"), "term", "n", "number", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"), "parts", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    tiles = heads.drop("blocks").unionByName(cells).withColumn("part", each("parts")).drop("parts")
    parts = written(tiles.groupBy("lang", "block", "part").applyInArrow(_block(top), "lang string, source string, part string, item string, value long"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    return pairs.unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))
