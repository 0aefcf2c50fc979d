"""Digesting streams of objects with Structured Streaming.

Each object, or segment of one, is digested on its own; what arrives is compared with
stored sets batch by batch. Only `first_digests` keeps state, of the digests that came lately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compare import compare_to
from ..operators.digest import digest, digest_by_size
from ..operators.index import index_search
from ..operators.digest import features
from ..operators.segments import cut_segments


def file_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (name, content) of files as they come into a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path AS name", "content")


def digest_stream(objects: DataFrame, *, block_kib: int = -1) -> DataFrame:
    """Digests of a stream of objects."""
    return digest_by_size(objects, requested_kib=block_kib)


def segment_stream(objects: DataFrame, *, segment: int = 128 << 20, block_size: int = 16 << 10) -> DataFrame:
    """Digests, in blocks, of the segments of a stream of objects."""
    return digest(cut_segments(objects, segment=segment), block_size=block_size)


def first_digests(digests: DataFrame, time_col: str, *, delay: str = "1 hour") -> DataFrame:
    """A stream of digests (with an event time) without those that have come before.

    Digests are the same if all but their names is: filters, counts, sizes and mode. One is passed on once; what comes within `delay` of it, by event time, is dropped.
    The state is one row of hashes for each digest of that span, whatever the size of the filters.
    """
    body = F.to_json(F.struct("mode", "input_size", "dd_block_size", "filters"))
    rows = digests.withColumn("content_key", F.sha2(body, 256)).withWatermark(time_col, delay)
    return rows.dropDuplicatesWithinWatermark(["content_key"])


def append_digests(digests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a stream of digests as Parquet, each exactly once."""
    return digests.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compare_stream(digests: DataFrame, references: DataFrame, path: str, checkpoint: str, *, threshold: int = 1, **trigger) -> StreamingQuery:
    """Compare a stream of digests with a stored set; a batch that is run again replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        compare_to(rows, references, threshold=threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return digests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(objects: DataFrame, index: DataFrame, path: str, checkpoint: str, *, block_size: int = 16 << 10, **trigger) -> StreamingQuery:
    """Search the blocks of a stream of objects in an index."""

    def batch(rows: DataFrame, number: int) -> None:
        index_search(features(rows, block_size=block_size), index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return objects.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
