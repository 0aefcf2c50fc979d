"""Digests as lines of text, one to a line, and back.

Stream mode: `sdbf:03:<bytes of name>:<name>:<size>:sha1:256:5:7ff:160:<filters>:<elements of the last>:<base64>`.
Block mode: `sdbf-dd:03:...:192:<filters>:<block size>` and for each filter
`:<elements in hex>:<base64>`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions import tables as t
from ..functions.columns import hamming
from ..operators.digest import DIGEST, _schema, digest_row

#: No digest line is shorter than a filter in base64.
MIN_LINE = 344


def _bytes_hex(words: Column) -> Column:
    """Hex of the words' bytes, least significant first."""
    def little(w: Column) -> Column:
        h = F.lpad(F.hex(w), 16, "0")
        return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))

    return F.array_join(F.transform(words, little), "")


def _base64(hexed: Column) -> Column:
    return F.translate(F.base64(F.unhex(hexed)), "\r\n", "")


def digest_line() -> Column:
    """A digest row as a line of text."""
    head = F.concat_ws(
        ":",
        F.when(F.col("mode") == "block", "sdbf-dd").otherwise("sdbf"),
        F.lit("03"),
        F.octet_length("name").cast("string"),
        "name",
        F.col("input_size").cast("string"),
        F.lit("sha1"),
        F.col("bf_size").cast("string"),
        F.col("hash_count").cast("string"),
        F.lower(F.hex("mask")),
        F.col("max_elem").cast("string"),
        F.col("bf_count").cast("string"),
    )
    whole = _base64(F.array_join(F.transform("filters", lambda f: _bytes_hex(f["words"])), ""))
    parts = F.array_join(F.transform("filters", lambda f: F.concat(F.lpad(F.lower(F.hex(f["elem_count"])), 2, "0"), F.lit(":"), _base64(_bytes_hex(f["words"])))), ":")
    stream = F.concat_ws(":", head, F.col("last_count").cast("string"), whole)
    block = F.concat(F.concat_ws(":", head, F.col("dd_block_size").cast("string")), F.when(F.size("filters") > 0, F.concat(F.lit(":"), parts)).otherwise(""))
    return F.when(F.col("mode") == "block", block).otherwise(stream)


def write_digests(digests: DataFrame, path: str, order: str | None = None) -> None:
    """Text files of digests, in order of a column if one is given."""
    rows = digests.orderBy(order) if order else digests
    rows.select(digest_line().alias("value")).write.text(path)


class InvalidDigest(ValueError):
    """A line that is no digest."""


def parse_line(line: str) -> dict:
    """A digest row from its line. The name's length is honoured, so names may hold colons."""
    raw = line.encode()
    if len(raw) < MIN_LINE:
        raise InvalidDigest("too short")
    magic, _, rest = raw.partition(b":")
    if magic not in (b"sdbf", b"sdbf-dd"):
        raise InvalidDigest("no digest")
    try:
        _, length, rest = rest.split(b":", 2)
        name, rest = rest[: int(length)].decode(), rest[int(length) :]
        if rest[:1] != b":":
            raise InvalidDigest("bad name")
        fields = rest[1:].decode("ascii").split(":")
        size, count, last = int(fields[0]), int(fields[6]), int(fields[7])
        if magic == b"sdbf":
            data = base64.b64decode(fields[8], validate=True)
            if len(fields) != 9 or len(data) != count * t.SMALL_BYTES or not 0 <= last <= t.MAX_STREAM:
                raise InvalidDigest("wrong length")
            counts = [t.MAX_STREAM] * (count - 1) + [last]
            filters = [data[i : i + t.SMALL_BYTES] for i in range(0, len(data), t.SMALL_BYTES)]
            return digest_row(name, size, kernel.Digest(filters, counts), 0)
        parts = fields[8:]
        counts, filters = [int(x, 16) for x in parts[::2]], [base64.b64decode(x, validate=True) for x in parts[1::2]]
        if len(filters) != count or len(counts) != count or any(len(f) != t.SMALL_BYTES for f in filters):
            raise InvalidDigest("wrong length")
        return digest_row(name, size, kernel.Digest(filters, counts), last)
    except (ValueError, IndexError) as e:
        raise e if isinstance(e, InvalidDigest) else InvalidDigest(str(e)) from e


def parse_digests(lines: DataFrame, column: str = "value", *, invalid: str = "raise") -> DataFrame:
    """Digest rows from a column of lines; blank and null lines are passed over.

    invalid: raise, or drop lines that are no digest.
    """
    schema = _schema(lines, DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                try:
                    out.append(parse_line(line))
                except InvalidDigest:
                    if invalid == "raise":
                        raise
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return lines.select(F.col(column).cast("string").alias("line")).where("line is not null and line <> ''").mapInArrow(run, DIGEST)


def read_digests(spark: SparkSession, path: str | list[str], *, invalid: str = "raise", to_blank: bool = True) -> DataFrame:
    """Digest rows of text files.

    to_blank: a file's set ends at its first empty line, if it has one; else such lines are
    passed over. Where a file has one is asked first, of lines as short as that; then each
    line is known by its place in the file, so a file can still be read in parts.
    """
    lines = spark.read.text(path)
    if to_blank:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
        lines = lines.select("value", place.alias("place"))
        first = lines.where(F.col("value") == "").groupBy("place.file").agg(F.min(F.struct("place.part", "place.row")).alias("first"))
        ended = lines.join(first, F.col("place.file") == F.col("file"), "left")
        lines = ended.where(F.col("first").isNull() | (F.struct("place.part", "place.row") < F.col("first"))).select("value")
    return parse_digests(lines, invalid=invalid)


def validate(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lines, valid, filters, input_size) of a column of digest lines."""
    rows = lines.where(F.coalesce(F.col(column), F.lit("")) != "")
    total = rows.agg(F.count("*").alias("lines"))
    good = parse_digests(rows, column, invalid="drop").agg(F.count("*").alias("valid"), F.coalesce(F.sum("bf_count"), F.lit(0)).alias("filters"), F.coalesce(F.sum("input_size"), F.lit(0)).alias("input_size"))
    return total.crossJoin(good)


def filter_line(words: Column, elements: Column, name: Column, mask: int = t.SMALL_MASK) -> Column:
    """A filter as a line of text: `bf:<bytes>:<elements>:<hashes>:<mask>:0:<name>:<base64>`; 0 says that it isn't packed."""
    head = F.concat_ws(":", F.lit("bf"), (F.size(words) * 8).cast("string"), elements.cast("string"), F.lit(str(t.HASHES)), F.lit(str(mask)), F.lit("0"), name)
    return F.concat(head, F.lit(":"), _base64(_bytes_hex(words)))


def parse_filters(lines: DataFrame, column: str = "value", *, folds: int = 0) -> DataFrame:
    """(name, elem_count, hash_count, mask, words, hamming) of lines that `filter_line` makes, each filter halved `folds` times.

    Halving ends at 32 words. A name holds no colon; other lines give null words.
    """
    parts = F.split(F.col(column).cast("string"), ":", 8)
    digits = F.hex(F.unbase64(parts[7]))
    word = lambda i: F.conv(F.concat(*(F.substring(digits, (i * 16 + 15 - 2 * k).cast("int"), F.lit(2)) for k in range(8))), 16, -10).cast("long")
    words = F.when(F.length(digits) >= 16, F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 16).cast("int") - 1), word))
    rows = lines.select(parts[6].alias("name"), parts[2].cast("long").alias("elem_count"), parts[3].cast("int").alias("hash_count"), parts[4].cast("long").alias("mask"), words.alias("words"))
    for _ in range(folds):
        half = F.floor(F.size("words") / 2).cast("int")
        folded = F.zip_with(F.slice("words", F.lit(1), half), F.slice("words", half + 1, half), lambda x, y: x.bitwiseOR(y))
        rows = rows.withColumn("words", F.when(F.size("words") > 32, folded).otherwise(F.col("words")))
    return rows.withColumn("hamming", hamming(F.col("words")))


def read_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Digest rows of all `*.sdbf` files of a folder, with the file's name without its end as index_set.

    So the sets lie that belong to the index files beside them.
    """
    lines = spark.read.option("pathGlobFilter", "*.sdbf").text(folder).select("value", F.input_file_name().alias("file"))
    stem = F.regexp_extract(F.expr("url_decode(replace(file, '+', '%2B'))"), r"([^/]*)\.sdbf$", 1)
    rows = lines.select(F.coalesce("value", F.lit("")).alias("value"), stem.alias("index_set")).where("value <> ''")
    schema = _schema(rows, DIGEST).append(pa.field("index_set", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [parse_line(line) | {"index_set": name} for line, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, f"{DIGEST}, index_set string")
