"""Digesting columns of bytes.

Objects are rows (name, content). Digests are plain nested rows; a set of digests is
any DataFrame of them. Only the kernel runs in Python, in Arrow batches; objects that
are too small are filtered before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions import tables as t
from ..functions.columns import eligible
from .storage import spread

FILTER = "struct<idx:int,elem_count:int,hamming:int,words:array<bigint>>"
DIGEST = (
    "name string, mode string, input_size bigint, bf_size int, hash_count int, mask int, max_elem int, "
    f"bf_count int, last_count int, dd_block_size int, filters array<{FILTER}>"
)
LARGE_FILTER = "struct<bf_size:bigint,max_elem:bigint,elem_count:bigint,words:array<bigint>>"
LARGE = f"name string, file_size bigint, filter_count int, filters array<{LARGE_FILTER}>"
FEATURES = "name string, block bigint, offset bigint, score int, sha1 binary"


def words_of(bits: bytes) -> np.ndarray:
    """Bytes of a filter as 64-bit words."""
    return np.frombuffer(bits, dtype="<i8")


def filter_row(i: int, bits: bytes, elements: int) -> dict:
    words = words_of(bits)
    return {"idx": i, "elem_count": elements, "hamming": int(np.bitwise_count(words.view(np.uint64)).sum()), "words": words.tolist()}


def digest_row(name: str, size: int, made: kernel.Digest, block: int) -> dict:
    """A digest as a row; block: 0 in stream mode."""
    return {
        "name": name,
        "mode": "block" if block else "stream",
        "input_size": size,
        "bf_size": t.SMALL_BYTES,
        "hash_count": t.HASHES,
        "mask": t.SMALL_MASK,
        "max_elem": t.MAX_BLOCK if block else t.MAX_STREAM,
        "bf_count": len(made.filters),
        "last_count": made.counts[-1] if made.counts and not block else 0,
        "dd_block_size": block,
        "filters": [filter_row(i, b, n) for i, (b, n) in enumerate(zip(made.filters, made.counts, strict=True))],
    }


def declared(data: Column, size: Column) -> Column:
    """Bytes as an object of a declared size: zeros follow up to it, and what is beyond is left out.

    Null if the bytes, or the size, are fewer than a digest needs.
    """
    size = size.cast("int")
    padded = F.concat(F.substring(data, F.lit(1), size), F.unhex(F.repeat(F.lit("00"), F.greatest(size - F.octet_length(data), F.lit(0)))))
    return F.when(eligible(data) & (size >= t.MIN_SIZE), padded)


def digest_declared(df: DataFrame, size: str | Column, name: str | Column = "name", data: str | Column = "content", *, block_size: int = 0, ranks: Sequence[int] | None = None) -> DataFrame:
    """Digests of objects of which `size` bytes are declared: over that many, with zeros behind what there is.

    Their input_size is what there is of them, as if read into a buffer of the declared size.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(column(name).cast("string").alias("name"), column(data).cast("binary").alias("content"), column(size).cast("int").alias("size"))
    rows = rows.select(F.struct("name", F.least(F.octet_length("content"), "size").alias("there")).alias("who"), declared(F.col("content"), F.col("size")).alias("content"))
    made = digest(rows.select(F.to_json("who").alias("name"), "content"), block_size=block_size, ranks=ranks)
    who = F.from_json("name", "name string, there bigint")
    return made.withColumn("input_size", who["there"]).withColumn("name", who["name"])


def _objects(df: DataFrame, name: str | Column, data: str | Column) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(column(name).cast("string").alias("name"), column(data).cast("binary").alias("content"))
    rows = rows.where(eligible(F.col("content")))
    return rows if rows.isStreaming else spread(rows)


def _schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _per_object(rows: DataFrame, ddl: str, make: Callable[[str, bytes, Iterator[np.ndarray]], Iterator[dict]], pieces: Callable[[bytes], list[tuple[int, int]]] | None = None, ranks: np.ndarray | None = None) -> DataFrame:
    """`make` gives the result rows of (name, content); pieces: those of an object whose votes it takes, counted for many objects at once."""
    schema = _schema(rows, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1)
            parts = (x[a : a + n] for x in (y.as_py() for y in contents) for a, n in pieces(x)) if pieces else ()
            votes = kernel.votes_of(parts, ranks)
            out = []
            for name, data in zip(batch.column(0), contents, strict=True):
                out.extend(make(name.as_py(), data.as_py(), votes))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, ddl)


def _pieces(block_size: int = 0) -> Callable[[bytes], list[tuple[int, int]]]:
    """What is digested on its own: an object's blocks, or its chunks."""
    return lambda content: kernel.blocks(len(content), block_size) if block_size else kernel.chunks(len(content))


def digest(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, block_size: int = 0, ranks: Sequence[int] | None = None) -> DataFrame:
    """Digests of all objects of at least 512 bytes.

    block_size: bytes of a block, or 0 for a digest of the whole object. ranks: rank
    table, by default that of the rule. Null objects have no digest; a null name stays
    null.
    """
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        made = kernel.block_digest(content, block_size, table, votes) if block_size else kernel.stream_digest(content, table, votes=votes)
        yield digest_row(who, len(content), made, block_size)

    return _per_object(_objects(df, name, data), DIGEST, make, _pieces(block_size), table)


def digest_by_size(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, requested_kib: int = -1, limit: int = t.SMALL_OBJECT, ranks: Sequence[int] | None = None) -> DataFrame:
    """Digests with the block size that an object's size asks for."""
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)
    asked = max(-1, min(16, requested_kib))

    def block_of(content: bytes) -> int:
        small = len(content) < limit
        return 1024 * ((asked if asked >= 1 else 0) if small else (16 if asked == -1 else asked))

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        block = block_of(content)
        made = kernel.block_digest(content, block, table, votes) if block else kernel.stream_digest(content, table, votes=votes)
        yield digest_row(who, len(content), made, block)

    return _per_object(_objects(df, name, data), DIGEST, make, lambda content: _pieces(block_of(content))(content), table)


def large_digest(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, ranks: Sequence[int] | None = None) -> DataFrame:
    """Digests of filters of 16 KB, filled as in stream mode."""
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        made = kernel.stream_digest(content, table, votes=votes).large
        rows = [{"bf_size": t.LARGE_BYTES, "max_elem": t.MAX_LARGE, "elem_count": n, "words": words_of(b)} for b, n in made]
        yield {"name": who, "file_size": len(content), "filter_count": len(rows), "filters": rows}

    return _per_object(_objects(df, name, data), LARGE, make, _pieces(), table)


def features(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, block_size: int = 0, ranks: Sequence[int] | None = None) -> DataFrame:
    """(name, block, offset, score, sha1) of the features of all objects.

    In stream mode these are all candidates, block 0; with a block size those that
    each block's filter counts.
    """
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        if not block_size:
            for i, v, sha in kernel.stream_features(content, table, votes=votes):
                yield {"name": who, "block": 0, "offset": i, "score": v, "sha1": sha}
            return
        for number, (start, length) in enumerate(kernel.blocks(len(content), block_size)):
            _, counted = kernel.block_features(content[start : start + length], table, length < block_size, next(votes))
            for i, v, sha in counted:
                yield {"name": who, "block": number, "offset": start + i, "score": v, "sha1": sha}

    return _per_object(_objects(df, name, data), FEATURES, make, _pieces(block_size), table)


def window_statistics(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, ranks: Sequence[int] | None = None) -> DataFrame:
    """(name, entropy, n): how many windows of each object fall into each entropy class."""

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        for start, length in kernel.chunks(len(content)):
            found = kernel.entropies(np.frombuffer(content[start : start + length], np.uint8))[:-1] >> 10
            for c, n in enumerate(np.bincount(found).tolist()):
                if n:
                    yield {"name": who, "entropy": c, "n": n}

    return _per_object(_objects(df, name, data), "name string, entropy int, n bigint", make)


def rank_histogram(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, ranks: Sequence[int] | None = None) -> DataFrame:
    """(name, rank, n): how many windows of each object have each rank."""
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        for start, length in kernel.chunks(len(content)):
            found = kernel.window_ranks(np.frombuffer(content[start : start + length], np.uint8), table)[: max(0, length - t.WINDOW)]
            for r, n in enumerate(np.bincount(found).tolist()):
                if n:
                    yield {"name": who, "rank": r, "n": n}

    return _per_object(_objects(df, name, data), "name string, rank int, n bigint", make)


def popularity_histogram(df: DataFrame, name: str | Column = "name", data: str | Column = "content", *, ranks: Sequence[int] | None = None) -> DataFrame:
    """(name, score, n): how many offsets of each object have how many votes."""
    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    def make(who: str, content: bytes, votes: Iterator[np.ndarray]):
        for _, length in kernel.chunks(len(content)):
            for s, n in enumerate(np.bincount(next(votes)[: max(0, length - t.WINDOW)]).tolist()):
                if n:
                    yield {"name": who, "score": s, "n": n}

    return _per_object(_objects(df, name, data), "name string, score int, n bigint", make, _pieces(), table)


def fit_ranks(df: DataFrame, data: str | Column = "content") -> np.ndarray:
    """A rank table from a corpus: the rarer an entropy class is in it, the lower its rank."""
    found = window_statistics(df, F.lit("all"), data).groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    seen = {r["entropy"]: r["n"] for r in found}
    classes = np.arange(1, 1000)
    return t.ranked(classes, np.array([seen.get(int(c), 0) for c in classes]))
