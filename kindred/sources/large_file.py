"""Files of large digests: length-prefixed protocol-buffer messages.

A message for the digest (1 filters, 2 name, 3 id, 4 file size), then one for each
filter (1 bytes, 2 most elements, 3 elements, 4 id, 5 name, 6 words). Lengths are
32-bit, little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..operators.digest import LARGE, _schema
from .file_sink import write_files


#: What stands before each word of a filter.
_WORD = 6 << 3 | 1


class InvalidLargeDigest(ValueError):
    """Bytes that are no file of large digests."""


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(fields: list[tuple[int, int | str]]) -> bytes:
    out = b""
    for number, value in fields:
        if isinstance(value, str):
            raw = value.encode()
            out += _varint(number << 3 | 2) + _varint(len(raw)) + raw
        else:
            out += _varint(number << 3) + _varint(value)
    return out


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; words that follow one another come as one value, packed."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise InvalidLargeDigest("broken number")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        if data[at] == _WORD:
            words = np.frombuffer(data, np.uint8, (len(data) - at) // 9 * 9, at).reshape(-1, 9)
            other = np.flatnonzero(words[:, 0] != _WORD)
            n = int(other[0]) if len(other) else len(words)
            if n > 1:
                yield _WORD >> 3, words[:n, 1:].tobytes()
                at += 9 * n
                continue
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None or at + size > len(data):
            raise InvalidLargeDigest("broken field")
        raw, at = data[at : at + size], at + size
        yield tag >> 3, int.from_bytes(raw, "little") if kind in (1, 5) else raw


def _frame(message: bytes) -> bytes:
    return struct.pack("<i", len(message)) + message


def pack_large(row: dict) -> bytes:
    """A large digest row as bytes of a file."""
    filters = row["filters"]
    out = [_frame(_message([(1, len(filters)), (2, row["name"]), (3, 0), (4, row["file_size"])]))]
    for i, f in enumerate(filters):
        head = _message([(1, f["bf_size"]), (2, f["max_elem"]), (3, f["elem_count"]), (4, i), (5, row["name"])])
        words = np.empty((len(f["words"]), 9), np.uint8)
        words[:, 0] = _WORD
        words[:, 1:] = np.asarray(f["words"], "<i8").view(np.uint8).reshape(-1, 8)
        out.append(_frame(head + words.tobytes()))
    return b"".join(out)


def unpack_large(data: bytes) -> Iterator[dict]:
    """Large digest rows of a file; the words of a filter are an array."""
    at = 0

    def message() -> bytes:
        nonlocal at
        if at + 4 > len(data):
            raise InvalidLargeDigest("broken frame")
        (size,) = struct.unpack_from("<i", data, at)
        if size < 0 or at + 4 + size > len(data):
            raise InvalidLargeDigest("broken frame")
        at += 4 + size
        return data[at - size : at]

    while at < len(data):
        head = dict(_fields(message()))
        filters = []
        for _ in range(head.get(1, 0)):
            one: dict = {"bf_size": t.LARGE_BYTES, "max_elem": 0, "elem_count": 0}
            words = []
            for number, value in _fields(message()):
                if number in (1, 2, 3):
                    one[("bf_size", "max_elem", "elem_count")[number - 1]] = value
                elif number == 6:  # one word, or all of them packed
                    words.append(value.to_bytes(8, "little") if isinstance(value, int) else value)
            if any(len(x) % 8 for x in words):
                raise InvalidLargeDigest("broken words")
            filters.append(one | {"words": np.frombuffer(b"".join(words), "<i8")})
        yield {"name": head.get(2, b"").decode(), "file_size": head.get(4, 0), "filter_count": len(filters), "filters": filters}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Large digest rows of a batch, with the words of a filter as an array."""
    columns = {c: batch.column(c) for c in ("name", "file_size", "filters")}
    filters = columns["filters"].flatten()
    fields = {c: filters.field(c) for c in ("bf_size", "max_elem", "elem_count", "words")}
    words, at = fields.pop("words"), 0
    sizes = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    values = words.flatten().to_numpy()
    for name, size, n in zip(columns["name"].to_pylist(), columns["file_size"].to_pylist(), columns["filters"].value_lengths().to_pylist(), strict=True):
        own = range(at, at + n)
        at += n
        yield {"name": name, "file_size": size, "filters": [{c: x[i].as_py() for c, x in fields.items()} | {"words": values[sizes[i] : sizes[i + 1]]} for i in own]}


def export_large(digests: DataFrame) -> DataFrame:
    """(name, file): the bytes of each large digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([pack_large(r) for r in _rows(batch)], pa.binary())], names=["name", "file"])

    return digests.select("name", "file_size", "filter_count", "filters").mapInArrow(run, "name string, file binary")


def write_large(digests: DataFrame, folder: str, name: str) -> None:
    """Write large digests as files `name-N.sdbflg` of a folder, one for each partition, all of them or none."""
    part = F.format_string(f"{name}-%05d.sdbflg", F.spark_partition_id())
    write_files(export_large(digests).select(part.alias("name"), F.col("file").alias("content")), folder)


def parse_large(files: DataFrame, column: str = "content") -> DataFrame:
    """Large digest rows of a column of file contents."""
    schema = _schema(files, LARGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for data in batch.column(0) if data.is_valid for r in unpack_large(data.as_py())]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select(F.col(column).alias("content")).mapInArrow(run, LARGE)


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """Large digest rows of files."""
    return parse_large(spark.read.format("binaryFile").load(path))


def large_details(digests: DataFrame) -> DataFrame:
    """A line about each large digest."""
    return digests.select(F.concat_ws(" ", "name", F.lit("size"), F.col("file_size").cast("string"), F.lit("filter count"), F.col("filter_count").cast("string")).alias("value"))
