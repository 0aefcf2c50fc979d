"""Command line: digests of files, comparisons, indexes and checks.

python -m kindred [options] FILES...           digest files and print the digests
python -m kindred --gen-compare FILES...       digest files and compare them all
python -m kindred --compare A [B]              compare one digest file with itself, or two
python -m kindred -                            digest the standard input in segments
python -m kindred --large -o DIR FILES...      large digests, as files of their own format
python -m kindred --index NAME FILES...        build an index of files (with --output), a file for each batch
python -m kindred --index-search DIR FILES...  search files in the indexes of a folder
python -m kindred --validate FILES...          check digest files
python -m kindred --details FILES...           describe files of large digests
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __doc__ as about
from .functions import tables as t
from .operators import compare, digest, index, segments
from .plans.options import Options, UnknownOption
from .sources import digest_text, files, index_file, large_file
from .sources import segments as segment_source

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description=about)
    p.add_argument("files", nargs="*", help="files and folders, or - for the standard input")
    p.add_argument("--hash-name", help="name of the standard input's digests (stdin)")
    p.add_argument("-r", "--deep", action="store_true", default=None, help="files of folders, too")
    p.add_argument("-f", "--target-list", help="text file that names files, one to a line")
    p.add_argument("--root", default="/", help="folder that the files of a list are under")
    p.add_argument("-c", "--compare", action="store_true")
    p.add_argument("-g", "--gen-compare", action="store_true")
    p.add_argument("-t", "--threshold", type=int, help="least score that is shown (1)")
    p.add_argument("-b", "--block-size", type=int, help="KiB of a block; 0: whole objects; -1: by size")
    p.add_argument("-s", "--sample-size", type=int, help="filters of a query that are compared; 0: all")
    p.add_argument("-z", "--segment-size", type=int, help="MB of a segment of large files (128)")
    p.add_argument("-p", "--threads", type=int, help="threads; 0: all cores")
    p.add_argument("-o", "--output", help="folder for the result instead of printing it")
    p.add_argument("--separator", choices=sorted(compare.SEPARATORS))
    p.add_argument("--fast", action="store_true", default=None, help="compare folded filters")
    p.add_argument("--large", action="store_true", default=None, help="filters of 16 KB")
    p.add_argument("--index", metavar="NAME")
    p.add_argument("--index-search", metavar="DIR")
    p.add_argument("--validate", action="store_true")
    p.add_argument("--details", action="store_true")
    p.add_argument("--ranks", help="text file with a rank table")
    p.add_argument("--config-file")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def _emit(lines: DataFrame, output: str) -> None:
    """Lines into a folder, or to the console as they come."""
    if output:
        lines.write.text(output)
        return
    for row in lines.toLocalIterator():
        print(row[0])


def _objects(spark: SparkSession, args: argparse.Namespace, options: Options) -> DataFrame:
    """(name, content) of what is digested, in segments; `-` is the standard input."""
    size = options.segment_size << 20
    if args.target_list:
        return segments.cut_segments(files.read_target_list(spark, args.target_list, args.root), segment=size)
    if args.files == ["-"]:
        path = segment_source.keep_stream(spark, sys.stdin.buffer)
        return segment_source.read_segments(spark, path, segment=size, label=args.hash_name or "stdin").select("name", "content")
    return segment_source.read_segments(spark, args.files, segment=size, recursive=bool(options.deep)).select("name", "content")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    given = {k: v for k, v in vars(args).items() if v is not None and k in Options.__dataclass_fields__}
    try:
        options = Options.load(args.config_file, **given)
    except UnknownOption as e:
        print(f"unknown option: {e}", file=sys.stderr)
        return 2
    builder = SparkSession.builder.appName("kindred")
    if options.threads:
        builder = builder.master(f"local[{options.threads}]")
    spark = builder.getOrCreate()
    ranks = t.read_ranks(args.ranks) if args.ranks else None
    numbered = lambda d: d.withColumn("digest_id", F.monotonically_increasing_id())
    if args.compare:
        if len(args.files) not in (1, 2):
            print("one or two digest files are compared", file=sys.stderr)
            return 2
        read = large_file.read_large if options.large else digest_text.read_digests
        sets = [read(spark, f) for f in args.files]
        if options.large:
            found = compare.compare_large(numbered(sets[0]) if len(sets) == 1 else sets[0], *sets[1:], threshold=options.threshold)
        elif len(sets) == 1:
            found = compare.compare_all(numbered(sets[0]), threshold=options.threshold, fast=options.fast)
        else:
            found = compare.compare_to(*sets, threshold=options.threshold, sample=options.sample_size, fast=options.fast)
        _emit(compare.comparison_lines(found, options.separator), options.output)
    elif args.validate:
        for f in args.files:
            row = digest_text.validate(spark.read.text(f)).first()
            print(f"{f}: {row['valid']} of {row['lines']} digests valid, {row['filters']} filters, {row['input_size']} bytes of input")
    elif args.details:
        _emit(large_file.large_details(large_file.read_large(spark, args.files)), options.output)
    elif args.index:
        if not options.output:
            print("an index needs --output", file=sys.stderr)
            return 2
        found = digest.features(_objects(spark, args, options), block_size=t.BLOCK, ranks=ranks)
        objects = _objects(spark, args, options)
        index_file.write_indexes(found, objects.select("name", F.octet_length("content").alias("size")), args.index, options.output)
    elif args.index_search:
        found = digest.features(_objects(spark, args, options), block_size=t.BLOCK, ranks=ranks)
        _emit(index.hit_lines(index.index_search(found, index_file.read_indexes(spark, args.index_search))), options.output)
    elif options.large:
        if not options.output:
            print("large digests need --output", file=sys.stderr)
            return 2
        made = digest.large_digest(_objects(spark, args, options), ranks=ranks)
        folder = options.output if "://" in options.output else os.path.abspath(options.output)
        large_file.write_large(made, folder, "digests")
        _emit(files.list_files(spark, folder).select("name").where("name LIKE '%.sdbflg'"), "")
    else:
        block = options.block_size if args.files != ["-"] or options.block_size > 0 else 16  # a stream's digests are always in blocks
        made = digest.digest_by_size(_objects(spark, args, options), requested_kib=block, ranks=ranks)
        if args.gen_compare:
            found = compare.compare_all(numbered(made), threshold=options.threshold, fast=options.fast)
            _emit(compare.comparison_lines(found, options.separator), options.output)
        else:
            _emit(made.select(digest_text.digest_line().alias("value")), options.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
