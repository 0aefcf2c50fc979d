"""Index files: a line `sdbf-idx:<bytes>:<elements>:<hashes>:<mask>:<packed bytes>:<set>` and an LZ4 block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..operators import index as ops
from ..operators.storage import keep
from .file_sink import write_files

#: Bytes of a row's bitmap.
BITMAP = 4096


class InvalidIndex(ValueError):
    """A file that is no index."""


def pack_index(name: str, bits: bytes, elements: int, hashes: int = t.HASHES) -> bytes:
    packed = pa.Codec("lz4_raw").compress(bits, asbytes=True)
    head = f"sdbf-idx:{len(bits)}:{elements}:{hashes}:{len(bits) * 8 - 1}:{len(packed)}:{name}\n"
    return head.encode() + packed


def unpack_index(data: bytes) -> tuple[str, bytes, int]:
    """(name, bits, elements) of an index file."""
    head, line, body = data.partition(b"\n")
    parts = head.decode("utf-8", "replace").split(":", 6)
    if not line or len(parts) != 7 or parts[0] != "sdbf-idx":
        raise InvalidIndex("no index")
    try:
        size, elements, packed = int(parts[1]), int(parts[2]), int(parts[5])
        bits = pa.Codec("lz4_raw").decompress(body[:packed], decompressed_size=size, asbytes=True)
    except (ValueError, OSError) as e:
        raise InvalidIndex(str(e)) from e
    return parts[6], bits, elements


def export_index(index: DataFrame, elements: DataFrame | None = None, *, size: int = t.INDEX_BYTES) -> DataFrame:
    """(index_set, file): the bytes of an index file for each set, of a fixed size before packing.

    elements: (index_set, elements), else they count as 0.
    """
    rows = index.join(elements, "index_set", "left") if elements is not None else index.withColumn("elements", F.lit(0))
    rows = rows.select("index_set", "bucket", "bitmap", F.coalesce("elements", F.lit(0)).cast("long").alias("elements"))

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, dtype=np.uint8)
        for bucket, bitmap in zip(table.column("bucket").to_pylist(), table.column("bitmap").to_pylist(), strict=True):
            at = (bucket - 1) * BITMAP
            part = np.frombuffer(bitmap, np.uint8)[: max(0, size - at)]
            bits[at : at + len(part)] |= part
        name = table.column("index_set")[0].as_py()
        return pa.table({"index_set": pa.array([name]), "file": pa.array([pack_index(name, bits.tobytes(), table.column("elements")[0].as_py())], pa.binary())})

    return rows.groupBy("index_set").applyInArrow(run, "index_set string, file binary")


def write_indexes(features: DataFrame, objects: DataFrame, name: str, folder: str, *, limit: int = t.INDEX_BATCH) -> None:
    """Index files `name`N.idx of a collection in a folder, one for each batch of about `limit` bytes, with true counts of elements.

    Executors write them, all or none; a task has one index at a time, of 64 MB.
    """
    rows = keep(ops.in_batches(features, objects, name, limit=limit).select("index_set", "name", "block", "offset", "sha1"))
    made = export_index(ops.build_index(rows, "index_set"), ops.counted_elements(rows, "index_set"))
    write_files(made.select(F.concat("index_set", F.lit(".idx")).alias("name"), F.col("file").alias("content")), folder)


def read_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """(index_set, bucket, bitmap, elements) of all `*.idx` files of a folder; empty bitmaps are left out."""
    return parse_indexes(spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder))


def parse_indexes(files: DataFrame) -> DataFrame:
    """The same of a column `content` of index files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                name, bits, elements = unpack_index(data.as_py())
                parts = [(i // BITMAP + 1, bits[i : i + BITMAP].ljust(BITMAP, b"\0")) for i in range(0, len(bits), BITMAP)]
                parts = [(b, p) for b, p in parts if p.strip(b"\0")]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([b for b, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary()), pa.array([elements] * n, pa.int64())],
                    names=["index_set", "bucket", "bitmap", "elements"],
                )

    return files.select("content").mapInArrow(run, "index_set string, bucket long, bitmap binary, elements long")
