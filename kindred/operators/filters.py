"""Filters of groups of features, built, merged and compared by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.columns import feature_bits


def bits_of(features: DataFrame, group: str | Column, sha1_hex: str | Column = "sha1", *, mask: int = t.SMALL_MASK) -> DataFrame:
    """(grp, bit): the distinct bits that each group's features set."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    there = features.where(column(sha1_hex).isNotNull())
    return there.select(column(group).alias("grp"), F.explode(feature_bits(column(sha1_hex), mask)).alias("bit")).distinct()


def build_filters(features: DataFrame, group: str | Column, sha1_hex: str | Column = "sha1", *, size: int = t.SMALL_BYTES) -> DataFrame:
    """(grp, elements, words) of a filter of `size` bytes for each group.

    elements counts the group's distinct features. Words are summed up before the
    shuffle; a filter's words, of a fixed number, then meet in one row.
    """
    if size < 64 or size & (size - 1):
        raise ValueError("a filter's size is a power of two of at least 64 bytes")
    column = lambda c: F.col(c) if isinstance(c, str) else c
    once = features.select(column(group).alias("grp"), column(sha1_hex).alias("sha1")).where("sha1 is not null").distinct()
    elements = once.groupBy("grp").agg(F.count("*").cast("int").alias("elements"))
    bits = once.select("grp", F.explode(feature_bits(F.col("sha1"), size * 8 - 1)).alias("bit"))
    word = F.floor(F.col("bit") / 64).cast("int")
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = bits.groupBy("grp", word.alias("word")).agg(F.bit_or(one).alias("value"))
    packed = words.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(size // 8 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return packed.join(elements, "grp").select("grp", "elements", every.alias("words"))


def merge_bits(bits: DataFrame, group: str | Column) -> DataFrame:
    """Union of filters given as bits."""
    column = F.col(group) if isinstance(group, str) else group
    return bits.select(column.alias("grp"), "bit").distinct()


def fold_bits(bits: DataFrame, size: int) -> DataFrame:
    """Bits of filters folded to `size` bytes."""
    return bits.select("grp", (F.col("bit") % (size * 8)).alias("bit")).distinct()
