"""What the operators share of Spark: cut lineages, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir.

    Only where it is unset and all runs on one machine, as in tests, a temporary one is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, there as long as the driver's Python runs.

    Unlike a checkpoint, for which Spark computes the last stage twice, a table is
    computed once, and its size is known to the plans that read it.
    """
    return Step(df).df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over.

    It does so when the driver has collected the plans that used them. The last plan is
    still referred to until another one has run, and Python's references to the JVM end a
    little after Python's own collection.
    """
    spark.range(64, numPartitions=2).selectExpr("id % 7 AS k").distinct().write.format("noop").mode("overwrite").save()
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Rows and bytes that go to Python at a time in a step, at most; for texts, the usual ten thousand rows are much.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's limits of Arrow batches, lowered for what is computed inside."""
    before = {}
    for key, most in _BATCH.items():
        before[key] = spark.conf.get(key)
        own = re.fullmatch(r"([0-9]+)(?:b|B)?", before[key] or "")
        if own is None or not 0 < int(own[1]) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Step:
    """A table in the shared folder that can be replaced, as the state of a loop, or dropped once nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self._spark, self._path, self.df = df.sparkSession, None, df
        atexit.register(self.drop)
        self.set(df)

    def set(self, df: DataFrame) -> None:
        path = f"{shared_folder(self._spark)}/step-{uuid.uuid4().hex}"
        with _small_batches(self._spark):
            df.write.parquet(path)
        last, self._path = self._path, path
        if last is not None:
            _delete(self._spark, last)
        self.df = self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # Spark may have ended before
            if self._path is not None:
                _delete(self._spark, self._path)
        self._path = None
        atexit.unregister(self.drop)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in `edges` (a long, b long); root is the smallest id reachable.

    Alternates large-star and small-star steps until the forest is flat, which
    takes about log(n) rounds. A node's neighbours meet only in aggregates and in
    joins that Spark can split, never in a list.
    """
    step = Step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    flat = step.df.isEmpty()
    while not flat:
        tree = step.df
        both = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut off, so that the join has an exchange on both sides and Spark can split a node with very many neighbours
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step.set(small)
        # flat: every id has one parent, and no parent has one itself
        new = step.df
        n, ids, inner = new.join(new.select(F.col("a").alias("p")).distinct(), F.col("b") == F.col("p"), "left").agg(F.count("*"), F.count_distinct("a"), F.count("p")).first()
        flat = n == ids and inner == 0
    tree = step.df
    out = tree.select(F.col("a").alias("id"), F.col("b").alias("root")).union(tree.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    out = written(out)
    step.drop()
    return out


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` of a written table with `pos`, the place in its group by `order`, nulls first, and the group's size `n`.

    Rows are sorted by a range partitioning, so a group of any size is spread over tasks. Equal rows
    are dealt by a hash of their place in the table, so that many of them don't meet in one range;
    whichever of them is first, the result is the same.
    """
    keys = [group, *order, "__tie"]
    spread = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys)
    # rows of a partition are numbered one by one, from its number times 2**33 on
    step = written(spread.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__tie"))
    parts = step.groupBy(F.col(group).alias("__group"), F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    own = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("__group", "__part", "__low", before.alias("__before"), F.sum("__n").over(own).alias("n")))
    out = step.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.shiftright("__at", 33) == F.col("__part")))
    return out.withColumn("pos", F.col("__at") - F.col("__low") + F.col("__before")).drop("__group", "__part", "__at", "__low", "__before")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart, in order: by id, nulls last, and rows of one id by a hash of their text.

    Rows with the same id and the same text have the same key.
    """
    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    own = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.struct(number.isNull().alias("n"), F.coalesce(number, F.lit(0)).alias("id"), F.coalesce(own, F.lit(-1)).alias("t"))


def key_id(key: str) -> Column:
    """The id in a row's key."""
    return F.when(~F.col(f"{key}.n"), F.col(f"{key}.id"))


def flagged(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """`docs` with `__likely`: true for all rows whose `column` is among those of `wanted`, and a few more.

    A bitmap of hashes is broadcast, 16 bits for each wanted value up to 2**27 bits, 16 MB,
    so that an exact join behind it shuffles few other rows. With very many more
    wanted values it lets more rows pass, which costs time only.
    """
    bits = 1 << min(27, max(16, (16 * wanted.count()).bit_length()))
    number = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    place = wanted.select(number(column).alias("bit"))
    bitmap = place.groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bitmap"))
    joined = docs.withColumn("__bit", number(column)).join(F.broadcast(bitmap), F.bitmap_bucket_number("__bit") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(bitmap_bit_position(__bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    mask = F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")
    return joined.select(*docs.columns, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)).alias("__likely"))


def likely(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of `docs` whose `column` may be among those of `wanted`: all that are, and a few more."""
    return flagged(docs, wanted, column).where("__likely").drop("__likely")


def split(docs: DataFrame, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` as for `likely`, and all the others."""
    both = flagged(docs, wanted, column)
    return both.where("__likely").drop("__likely"), both.where("not __likely").drop("__likely")
