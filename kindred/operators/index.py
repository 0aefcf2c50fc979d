"""Indexes: Bloom filters of whole collections, as tables of bitmaps.

An index is rows (index_set, bucket, bitmap), a bitmap holding 32,768 of its bits.
It is built by aggregation and probed by joining the bits of features with it. Where
there are many indexes, a SlicedIndex has them side by side: a probe's work then grows with
the width of its bitmaps, not by a row for each set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.columns import feature_bits
from .compare import in_own_partitions, tiles_by_tiles
from .segments import plan_batches
from .storage import keep

#: Every so many counted features of a block are probed.
PROBE_EVERY = 4


def explode_bits(features: DataFrame, *keep: str, mask: int = t.INDEX_MASK) -> DataFrame:
    """A row for each bit that a feature sets."""
    return features.select(*keep, F.explode(feature_bits(F.lower(F.hex("sha1")), mask)).alias("bit"))


def build_index(features: DataFrame, set_col: str | Column = "name", *, mask: int = t.INDEX_MASK) -> DataFrame:
    """(index_set, bucket, bitmap) of the features of each set.

    Features are inserted independently of one another, so the result doesn't depend
    on their order.
    """
    name = F.col(set_col) if isinstance(set_col, str) else set_col
    bits = explode_bits(features.withColumn("index_set", name), "index_set", mask=mask)
    return bits.groupBy("index_set", F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))


def in_batches(features: DataFrame, objects: DataFrame, name: str, *, name_col: str = "name", size_col: str = "size", limit: int = t.INDEX_BATCH) -> DataFrame:
    """Features with their `index_set`: `name` with the number of its object's batch of about `limit` bytes behind it."""
    sized = objects if size_col in objects.columns else objects.withColumn(size_col, F.octet_length("content"))
    batches = plan_batches(sized, name=name_col, size=size_col, limit=limit).select(F.col("name").alias("__name"), "batch").distinct()
    rows = features.join(batches, F.col("name").eqNullSafe(F.col("__name")))
    return rows.withColumn("index_set", F.concat(F.lit(name), F.col("batch").cast("string"))).drop("__name", "batch")


def build_in_batches(features: DataFrame, objects: DataFrame, name: str, *, name_col: str = "name", size_col: str = "size", limit: int = t.INDEX_BATCH, mask: int = t.INDEX_MASK) -> DataFrame:
    """The index of a collection as one filter for each batch of about `limit` bytes of objects, so that none fills up.

    The sets are `name` with the batch's number behind it.
    """
    return build_index(in_batches(features, objects, name, name_col=name_col, size_col=size_col, limit=limit), "index_set", mask=mask)


def merge_indexes(indexes: DataFrame) -> DataFrame:
    """Union of indexes of the same name."""
    return indexes.groupBy("index_set", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    at = F.bitmap_bit_position(bit + 1)
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0


def probe_index(features: DataFrame, index: DataFrame, *, mask: int = t.INDEX_MASK) -> DataFrame:
    """(name, block, offset, index_set) of the features of which an index has all bits."""
    bits = explode_bits(features, "name", "block", "offset", mask=mask).distinct()
    wanted = bits.groupBy("name", "block", "offset").agg(F.count("*").alias("bits"))
    found = bits.withColumn("bucket", F.bitmap_bucket_number(F.col("bit") + 1)).join(index, "bucket").where(_is_set(F.col("bitmap"), F.col("bit")))
    found = found.groupBy("name", "block", "offset", "index_set").agg(F.count("*").alias("found"))
    return found.join(wanted, ["name", "block", "offset"]).where("found = bits").select("name", "block", "offset", "index_set")


def sample_features(features: DataFrame, every: int = PROBE_EVERY) -> DataFrame:
    """The first and then each `every`-th counted feature of each block."""
    number = F.row_number().over(Window.partitionBy("name", "block").orderBy("offset"))
    return features.withColumn("__n", number).where((F.col("__n") - 1) % every == 0).drop("__n")


def index_search(features: DataFrame, index: DataFrame, *, hits: int = t.INDEX_HITS, mask: int = t.INDEX_MASK) -> DataFrame:
    """(name, block, index_set, hits): blocks of which more than `hits` probed features are in an index."""
    return _hits(probe_index(sample_features(features), index, mask=mask), hits)


def _hits(found: DataFrame, hits: int) -> DataFrame:
    return found.groupBy("name", "block", "index_set").agg(F.count("*").cast("int").alias("hits")).where(F.col("hits") > hits)


def hit_lines(hits: DataFrame) -> DataFrame:
    """Index hits as text lines."""
    return hits.select(F.concat(F.col("name"), F.lit(" ["), F.col("block").cast("string"), F.lit("] |"), F.col("index_set"), F.lit("|"), F.col("hits").cast("string")).alias("value"))


def counted_elements(features: DataFrame, set_col: str | Column = "name", *, order: Sequence[str] = ("name", "block", "offset"), mask: int = t.INDEX_MASK) -> DataFrame:
    """(index_set, elements): how many features each index counts, inserted one after the other in this order.

    A feature counts if it sets a bit that no feature before it has set: exactly if it is
    the first one with one of its bits. So it takes the first feature of each bit, and no
    insertion in order. Equal features, and rows with the same order, are one element at most.
    """
    name = F.col(set_col) if isinstance(set_col, str) else set_col
    rows = features.withColumn("index_set", name).withColumn("__order", F.struct(*order, "sha1"))
    first = explode_bits(rows, "index_set", "__order", mask=mask).groupBy("index_set", "bit").agg(F.min("__order").alias("first"))
    return first.groupBy("index_set").agg(F.count_distinct("first").alias("elements"))


#: Words of 64 sets in a row of a sliced index.
SLICE_WORDS = 16
#: Bytes of a part of the sets, with all rows of a filter, up to which it is probed as a matrix; bytes of such parts, and features, that a task takes.
_MATRIX, _PARTS, _FEATURES = 1 << 20, 4 << 20, 1 << 16


def _packed(*columns: str):
    """Rows of a tile as one, with their columns as bytes."""

    def run(table: pa.Table) -> pa.Table:
        arrays = [np.stack([c.to_numpy() for c in table.select([w for w in table.column_names if w[0] == "w"]).columns], axis=1) if n == "words" else table.column(n).to_numpy() for n in columns]
        return pa.table([table.column("tile").slice(0, 1).combine_chunks(), *(pa.array([b"".join(x.tolist()) if x.dtype == object else x.tobytes()], pa.binary()) for x in arrays)], names=["tile", *columns])

    return run


def _probe_matrix(mask: int, words: int):
    """(sha1, part, place) of the features of which sets have all bits: five rows of a part's matrix for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shas, parts, bits, values in zip(*(batch.column(c) for c in ("sha1", "other_part", "other_bit", "other_words")), strict=True):
                sha = np.frombuffer(shas.as_buffer(), "S20")
                own = (sha.view("<u4").reshape(-1, 5) & np.uint32(mask)).astype(np.int64)
                part, bit = (np.frombuffer(x.as_buffer(), k) for x, k in ((parts, np.int32), (bits, np.int64)))
                value = np.frombuffer(values.as_buffer(), np.uint64).reshape(-1, words)
                order = np.argsort(part, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    matrix = np.zeros((mask + 1, words), np.uint64)
                    matrix[bit[rows]] = value[rows]
                    found = matrix[own[:, 0]]
                    for k in range(1, own.shape[1]):
                        found &= matrix[own[:, k]]
                    at = np.flatnonzero(found.any(axis=1))
                    i, place = np.nonzero(np.unpackbits(found[at].view(np.uint8), axis=1, bitorder="little"))
                    who = pa.Array.from_buffers(pa.binary(20), len(sha), [None, shas.as_buffer()]).take(pa.array(at[i])).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([who, pa.array(np.full(len(i), part[rows[0]], np.int32)), pa.array(place.astype(np.int32))], names=["sha1", "part", "place"])

    return run


@dataclass
class SlicedIndex:
    """Many indexes side by side: for each bit of a filter the sets that have it, as a bitmap.

    bits: (bit, part, w0, w1, ...), the words of one part of the sets, without rows of
    zeros; sets: (index_set, part, place), place being a bit in the part's words.
    A probe of a feature takes the five rows of its bits in each part, whatever the number of sets in it.
    Where filters are so narrow that parts are matrices, nothing is written for features times parts.
    """

    bits: DataFrame
    sets: DataFrame
    mask: int = t.INDEX_MASK

    @property
    def words(self) -> list[str]:
        return [c for c in self.bits.columns if c not in ("bit", "part")]

    def probe(self, features: DataFrame) -> DataFrame:
        """(name, block, offset, index_set) of the features of which an index has all bits.

        Each different feature is looked up once, so a frequent one is no hot key of the index.
        """
        place = self._places_narrow(features) if (self.mask + 1) * len(self.words) * 8 <= _MATRIX else self._places(features)
        found = place.join(self.sets, ["part", "place"]).select("sha1", "index_set")
        return features.select("name", "block", "offset", "sha1").distinct().join(found, "sha1").select("name", "block", "offset", "index_set")

    def _places(self, features: DataFrame) -> DataFrame:
        """(sha1, part, place) of the features that sets have; each bit is joined with its rows."""
        own = F.array_distinct(feature_bits(F.lower(F.hex("sha1")), self.mask))
        bits = features.select("sha1").distinct().select("sha1", F.size(own).alias("n"), F.explode(own).alias("bit"))
        both = bits.join(self.bits, "bit").groupBy("sha1", "part").agg(F.count("*").alias("found"), F.first("n").alias("n"), *(F.bit_and(w).alias(w) for w in self.words))
        word = both.where("found = n").select("sha1", "part", F.posexplode(F.array(*self.words)).alias("i", "word")).where("word <> 0")
        place = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("word"), b) == 1)
        place = word.select("sha1", "part", "i", F.explode(place).alias("b")).select("sha1", "part", (F.col("i") * 64 + F.col("b")).alias("place"))
        return place

    def _places_narrow(self, features: DataFrame) -> DataFrame:
        """The same where a filter has few bits: most parts have rows of each of them, so a join would write rows for features times parts.

        Tiles of features meet tiles of parts in a Cartesian product, where only what is found leaves a task.
        """
        asked = keep(features.select("sha1").where(F.octet_length("sha1") == 20).distinct())
        n = max(1, -(-asked.count() // _FEATURES))
        tiles = asked.withColumn("tile", F.pmod(F.xxhash64("sha1"), F.lit(n)).cast("int")).groupBy("tile").applyInArrow(_packed("sha1"), "tile int, sha1 binary")
        per = max(1, _PARTS // ((self.mask + 1) * len(self.words) * 8))
        m = (self.sets.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]) // per + 1
        parts = self.bits.where("bit is not null").select(F.floor(F.col("part") / per).cast("int").alias("tile"), "part", F.col("bit").cast("long").alias("bit"), *self.words)
        parts = parts.groupBy("tile").applyInArrow(_packed("part", "bit", "words"), "tile int, part binary, bit binary, words binary")
        both = tiles_by_tiles(in_own_partitions(tiles, n), in_own_partitions(parts, m))
        return both.mapInArrow(_probe_matrix(self.mask, len(self.words)), "sha1 binary, part int, place int")

    def search(self, features: DataFrame, *, hits: int = t.INDEX_HITS) -> DataFrame:
        """As `index_search`."""
        return _hits(self.probe(keep(sample_features(features).select("name", "block", "offset", "sha1"))), hits)

    def save(self, name: str, *, buckets: int = 64) -> None:
        """Keep it as tables of the warehouse, dealt by bit: a probe then moves its own bits only, not those of the index."""
        self.bits.repartition(buckets, "bit").write.bucketBy(buckets, "bit").sortBy("bit").mode("overwrite").saveAsTable(name)
        self.sets.withColumn("mask", F.lit(self.mask)).write.mode("overwrite").saveAsTable(f"{name}_sets")

    @classmethod
    def load(cls, spark: SparkSession, name: str) -> SlicedIndex:
        sets = spark.table(f"{name}_sets")
        first = sets.select("mask").first()
        return cls(spark.table(name), sets.drop("mask"), first[0] if first else t.INDEX_MASK)


def _sliced(bits: DataFrame, sets: DataFrame, mask: int, words: int) -> SlicedIndex:
    """Bits (index_set, bit) of numbered sets (index_set, number) side by side."""
    placed = keep(sets.select("index_set", F.floor(F.col("number") / (64 * words)).cast("int").alias("part"), F.pmod("number", F.lit(64 * words)).cast("int").alias("place")))
    word, flag = F.shiftright("place", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)))
    rows = bits.join(placed, "index_set").groupBy("bit", "part").agg(*(F.coalesce(F.bit_or(F.when(word == i, flag)), F.lit(0)).cast("long").alias(f"w{i}") for i in range(words)))
    return SlicedIndex(rows, placed, mask)


def _number_sets(names: DataFrame) -> DataFrame:
    """Sets in order of their names. One row for each set, which is about 640 MB of objects, is sorted in one task."""
    return names.select("index_set").distinct().where("index_set is not null").select("index_set", (F.row_number().over(Window.orderBy("index_set")) - 1).alias("number"))


def build_sliced(features: DataFrame, set_col: str | Column = "name", *, mask: int = t.INDEX_MASK, words: int = SLICE_WORDS) -> SlicedIndex:
    """The indexes of the features of each set, side by side; rows without a set are left out."""
    rows = features.select((F.col(set_col) if isinstance(set_col, str) else set_col).alias("index_set"), "sha1")
    rows = keep(rows)  # read for the sets' numbers, too
    return _sliced(explode_bits(rows, "index_set", mask=mask), _number_sets(rows), mask, words)


def slice_index(index: DataFrame, *, mask: int = t.INDEX_MASK, words: int = SLICE_WORDS) -> SlicedIndex:
    """Indexes as tables of bitmaps, such as those of index files, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, bucket, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array((bucket - 1) * _BITMAP_BITS + at)], names=["index_set", "bit"])

    bits = index.select("index_set", "bucket", "bitmap").mapInArrow(run, "index_set string, bit long")
    return _sliced(bits, _number_sets(index), mask, words)


#: Bits of one bitmap of an index.
_BITMAP_BITS = 1 << 15
