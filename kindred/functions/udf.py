"""Digests in SQL: functions and a table function to register in a session."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import kernel, score
from . import tables as t

FILTERS = "array<struct<idx:int,elem_count:int,hamming:int,words:array<bigint>>>"
_FILTERS = pa.list_(pa.struct([("idx", pa.int32()), ("elem_count", pa.int32()), ("hamming", pa.int32()), ("words", pa.list_(pa.int64()))]))


@F.arrow_udf("int")
def _score(name_a: pa.Array, a: pa.Array, name_b: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for p, x, q, y in zip(*(c.to_pylist() for c in (name_a, a, name_b, b)), strict=True):
        out.append(int(score.digest_scores(score.Filters.of([p or ""], [x]), score.Filters.of([q or ""], [y]))[0, 0]) if x and y else None)
    return pa.array(out, pa.int32())


def digest_score(name_a: Column, a: Column, name_b: Column, b: Column) -> Column:
    """Score, -1 to 100, of two digests, given by their names and filters; null without filters."""
    return _score(name_a, a, name_b, b)


def register(spark: SparkSession, *, ranks: Sequence[int] | None = None) -> None:
    """Make these known to the session's SQL.

    digest_filters(content): filters of the stream digest of an object of at least 512
    bytes, else null. digest_score(name_a, filters_a, name_b, filters_b): a score.
    digest_features(content): a table function, (offset, score, sha1) of the features.
    """
    from ..operators.digest import filter_row

    table = t.default_ranks() if ranks is None else t.check_ranks(ranks)

    @F.arrow_udf(FILTERS)
    def digest_filters(content: pa.Array) -> pa.Array:
        out = []
        for data in content.to_pylist():
            made = kernel.stream_digest(data, table) if data is not None and len(data) >= t.MIN_SIZE else None
            out.append(made and [filter_row(i, b, n) for i, (b, n) in enumerate(zip(made.filters, made.counts, strict=True))])
        return pa.array(out, _FILTERS)

    class Features:
        def eval(self, content: bytes) -> Iterator[tuple[int, int, bytes]]:
            if content is not None and len(content) >= t.MIN_SIZE:
                yield from kernel.stream_features(bytes(content), table)

    spark.udf.register("digest_filters", digest_filters)
    spark.udf.register("digest_score", _score)
    spark.udtf.register("digest_features", F.udtf(Features, returnType="offset bigint, score int, sha1 binary"))
