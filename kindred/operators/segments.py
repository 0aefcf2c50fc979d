"""How objects are cut: segments of large ones, blocks, and batches of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from .storage import keep


def segment_count(size: Column, segment: int) -> Column:
    """Segments of an object of `size` bytes; 0 as segment size means one.

    A rest of up to 512 bytes goes to the segment before it.
    """
    if segment <= 0:
        return F.lit(1).cast("long")
    whole = F.floor(size / segment)
    rest = size - whole * segment
    several = F.when(size - segment <= t.MIN_SIZE, 1).when(rest <= t.MIN_SIZE, whole).otherwise(whole + 1)
    return F.when(size > segment, several).otherwise(1).cast("long")


def plan_segments(objects: DataFrame, *, name: str = "name", size: str = "size", segment: int = 128 << 20, compat_tail: bool = False) -> DataFrame:
    """(name, segment, segment_name, start, length) of every segment.

    If there are several, their names get the start in MB. compat_tail: a merged rest
    is counted twice, as bytes of zero behind the object.
    """
    rows = objects.select(F.col(name).alias("name"), F.col(size).cast("long").alias("size")).where("size is not null")
    rows = rows.withColumn("n", segment_count(F.col("size"), segment))
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("segment") * segment
    last = F.col("segment") == F.col("n") - 1
    rest = F.col("size") % max(1, segment)
    merged = last & (F.col("size") > segment) & (F.col("n") > 1) & (rest <= t.MIN_SIZE)
    length = F.when(last, F.col("size") - start).otherwise(F.lit(segment))
    length = length + F.when(merged, rest).otherwise(0) if compat_tail else length
    label = F.when(F.col("n") > 1, F.concat("name", F.lit("."), F.lpad(F.floor(start / (1 << 20)).cast("string"), 4, "0"), F.lit("M"))).otherwise(F.col("name"))
    return rows.select("name", "segment", label.alias("segment_name"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def cut_segments(objects: DataFrame, *, name: str = "name", data: str = "content", segment: int = 128 << 20) -> DataFrame:
    """(name, content) of all segments; those of fewer than 512 bytes are left out."""
    rows = objects.select(F.col(name).alias("object"), F.col(data).alias("whole"), F.octet_length(data).cast("long").alias("size"))
    rows = rows.where("size is not null").withColumn("n", segment_count(F.col("size"), segment))
    rows = rows.select("object", "whole", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("segment"))
    start = F.col("segment") * segment
    length = F.when(F.col("segment") == F.col("n") - 1, F.col("size") - start).otherwise(F.lit(segment))
    label = F.when(F.col("n") > 1, F.concat("object", F.lit("."), F.lpad(F.floor(start / (1 << 20)).cast("string"), 4, "0"), F.lit("M"))).otherwise(F.col("object"))
    return rows.select(label.alias("name"), F.substring("whole", (start + 1).cast("int"), length.cast("int")).alias("content")).where(F.octet_length("content") >= t.MIN_SIZE)


def plan_blocks(objects: DataFrame, *, name: str = "name", size: str = "size", block: int = t.BLOCK) -> DataFrame:
    """(name, block, start, length, tail) of the blocks of objects of at least 512 bytes.

    A rest of fewer than 512 bytes has no block.
    """
    rows = objects.select(F.col(name).alias("name"), F.col(size).cast("long").alias("size")).where(F.col("size") >= t.MIN_SIZE)
    whole, rest = F.floor(F.col("size") / block), F.col("size") % block
    rows = rows.withColumn("n", (whole + F.when(rest >= t.MIN_SIZE, 1).otherwise(0)).cast("long")).where("n > 0")
    rows = rows.select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    start = F.col("block") * block
    length = F.least(F.lit(block).cast("long"), F.col("size") - start)
    return rows.select("name", "block", start.alias("start"), length.alias("length"), (length < block).alias("tail"))


def plan_batches(objects: DataFrame, *, name: str = "name", size: str = "size", limit: int = t.INDEX_BATCH) -> DataFrame:
    """(name, size, batch): objects in order of their names, a new batch for each `limit` bytes of all before.

    Ranges of names are summed side by side, and each goes on from the sum of those
    before it. A batch thus begins at the first object behind a multiple of the
    limit; a sum that starts anew with each batch would take all objects in one task.
    """
    spark = objects.sparkSession
    rows = keep(objects.select(F.col(name).cast("string").alias("name"), F.col(size).cast("long").alias("size")).repartitionByRange("name", "size").withColumn("range", F.spark_partition_id()))
    # one sum for each range
    sums = rows.groupBy("range").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).orderBy("range").collect()
    total, before = 0, []
    for r in sums:
        before.append((r["range"], total))
        total += r["bytes"]
    starts = spark.createDataFrame(before, "range int, before long")
    order = Window.partitionBy("range").orderBy("name", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(starts), "range").select("name", "size", F.floor((F.col("before") + F.col("own")) / limit).cast("int").alias("batch"))
