"""Objects from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t


def read_objects(spark: SparkSession, paths: str | list[str], *, recursive: bool = False, min_size: int = t.MIN_SIZE) -> DataFrame:
    """(name, size, content) of regular files; smaller ones are skipped without being read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return files.where(F.col("length") >= min_size).select(F.col("path").alias("name"), F.col("length").alias("size"), "content")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of all files under a folder; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size"))


def read_target_list(spark: SparkSession, lists: str | list[str], root: str, *, min_size: int = t.MIN_SIZE) -> DataFrame:
    """Files under `root` that are named, one to a line, in text files; others are passed over."""
    wanted = spark.read.text(lists).select(F.regexp_replace(F.trim("value"), "^file:/*", "/").alias("wanted")).where("wanted <> ''").distinct()
    objects = read_objects(spark, root, recursive=True, min_size=min_size)
    plain = F.regexp_replace("name", "^file:/*", "/")
    return objects.join(wanted, plain == F.col("wanted"), "left_semi")


def read_hex_digests(spark: SparkSession, path: str) -> DataFrame:
    """(sha1) of a text file with a SHA-1 in hex on each line; other lines are left out."""
    value = F.trim("value")
    return spark.read.text(path).where(value.rlike("^[0-9A-Fa-f]{40}$")).select(F.unhex(value).alias("sha1"))


def from_texts(table: DataFrame, name: str, text: str, prefix: str = "") -> DataFrame:
    """(name, size, content) of a text column."""
    content = F.encode(F.col(text), "utf-8")
    return table.select(F.concat(F.lit(prefix), F.col(name).cast("string")).alias("name"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
