"""A data source for files too large for one row: one row for each segment; small files share partitions.

spark.dataSource.register(SegmentSource)
spark.read.format("segments").option("path", "s3://...").option("segmentBytes", 128 << 20).load()

As a stream, it follows a folder whose files come and grow.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import tables as t
from ..operators.storage import shared_folder


def segment_bounds(size: int, segment: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a file; a rest of up to 512 bytes goes to the one before."""
    if segment <= 0 or size <= segment or size - segment <= t.MIN_SIZE:
        return [(0, size)]
    n = size // segment + (size % segment > t.MIN_SIZE)
    return [(i * segment, size - i * segment if i == n - 1 else segment) for i in range(n)]


#: Bytes of small files that one partition reads.
_TOGETHER = 64 << 20


class _Segments(InputPartition):
    def __init__(self, parts: list[tuple[str, str, int, int]]):
        self.parts = parts  # path, name, start and length of each segment


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.segment = int(options.get("segmentBytes", options.get("segmentbytes", 128 << 20)))
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        # names of streams that were kept in a file
        self.label = options.get("label")

    def files(self) -> list:
        """All files, by path."""
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=self.recursive))
        return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)

    def named(self, path: str, start: int, several: bool) -> str:
        label = self.label or path
        return f"{label}.{start >> 20:04d}M" if several or self.label else label

    def together(self, parts: list[tuple[str, str, int, int]]) -> list[_Segments]:
        """Segments in partitions; small ones share one."""
        out: list[list[tuple[str, str, int, int]]] = [[]]
        size = 0
        for part in parts:
            if size and size + part[3] > _TOGETHER:
                out.append([])
                size = 0
            out[-1].append(part)
            size += part[3]
        return [_Segments(p) for p in out]

    def partitions(self) -> list[_Segments]:
        parts = []
        for f in self.files():
            bounds = segment_bounds(f.size, self.segment)
            parts += [(f.path, self.named(f.path, a, len(bounds) > 1), a, n) for a, n in bounds if n >= t.MIN_SIZE]
        return self.together(parts)

    def read(self, partition: _Segments) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        for path, name, start, length in partition.parts:
            with files.open_input_file(path) as file:
                yield name, start, bytes(file.read_at(length, start))


class _Stream(DataSourceStreamReader):
    """Segments of files as they come and grow; an offset has the bytes of each file that are ready.

    From a file that changes, whole segments are ready, but for the last one; the rest
    follows once the file has not changed for `settleSeconds`. What comes behind it later is
    cut from there on.
    """

    def __init__(self, options: dict):
        self.reader = _Reader(options)
        self.settle = float(options.get("settleSeconds", options.get("settleseconds", 0)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now, segment, out = time.time(), self.reader.segment, {}
        for f in self.reader.files():
            changed = f.mtime_ns / 1e9 if f.mtime_ns is not None else 0
            ready = f.size
            if now - changed < self.settle:
                ready = max(0, f.size // segment - (f.size % segment <= t.MIN_SIZE)) * segment if segment > 0 else 0
            if ready:
                out[f.path] = ready
        return out

    def partitions(self, start: dict, end: dict) -> list[_Segments]:
        parts = []
        for path, ready in sorted(end.items()):
            begin = start.get(path, 0)
            if ready > begin:
                bounds = [(begin + a, n) for a, n in segment_bounds(ready - begin, self.reader.segment)]
                parts += [(path, self.reader.named(path, a, begin > 0 or len(bounds) > 1), a, n) for a, n in bounds if n >= t.MIN_SIZE]
        return self.reader.together(parts)

    def read(self, partition: _Segments) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: Spark's checkpoint has the offsets."""


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "name string, start bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read_segments(spark: SparkSession, paths: str | list[str], *, segment: int = 128 << 20, recursive: bool = False, label: str | None = None) -> DataFrame:
    """(name, start, content) of the segments of files, and of all files of folders, of any size.

    label: the name of all of them instead of their path; their start then always follows.
    """
    spark.dataSource.register(SegmentSource)
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        whole = path if "://" in path else os.path.abspath(path)
        reader = spark.read.format("segments").option("path", whole).option("segmentBytes", str(segment)).option("recursive", str(recursive))
        rows = (reader.option("label", label) if label else reader).load()
        out = rows if out is None else out.unionByName(rows)
    return out


def stream_segments(spark: SparkSession, folder: str, *, segment: int = 128 << 20, recursive: bool = False, settle_seconds: float = 60, label: str | None = None) -> DataFrame:
    """A stream of (name, start, content) of the segments of a folder's files, of any size, as they come and grow.

    A segment is read once, restarts included. A file that gets longer gives its whole
    segments at once and its rest when it has not changed for `settle_seconds`. Files must only grow: what is
    written anew in its place is not read again. The offset has an entry for each file that the
    folder has, so files that are done should leave it from time to time.
    """
    spark.dataSource.register(SegmentSource)
    whole = folder if "://" in folder else os.path.abspath(folder)
    reader = spark.readStream.format("segments").option("path", whole).option("segmentBytes", str(segment)).option("recursive", str(recursive)).option("settleSeconds", str(settle_seconds))
    return (reader.option("label", label) if label else reader).load()


def keep_stream(spark: SparkSession, stream: BinaryIO) -> str:
    """A stream of bytes, such as the standard input, as a file in the shared folder; returns its path."""
    from pyarrow import fs

    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    uri = path if "://" in path else re.sub("^file:/*", "/", path)
    files, place = fs.FileSystem.from_uri(uri)
    with files.open_output_stream(place) as out:
        while data := stream.read(1 << 20):
            out.write(data)
    return uri
