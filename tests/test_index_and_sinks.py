"""Indexes side by side, counts of elements, committed files, streams of segments."""

import hashlib
import os
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import kernel
from kindred.operators import digest, index
from kindred.sources import file_sink, index_file, segments

MASK = (1 << 12) - 1


@pytest.fixture(scope="module")
def features(spark):
    """Features of 150 sets, some in several of them, one in all."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        sha = hashlib.sha1(str(int(rng.integers(0, 400))).encode()).digest()
        rows.append((f"o{i % 37}", i % 3, i, sha, f"set-{int(rng.integers(0, 150))}"))
    rows += [("all", 0, i, hashlib.sha1(b"all").digest(), f"set-{i}") for i in range(150)]
    rows.append((None, None, None, hashlib.sha1(b"nameless").digest(), None))
    return spark.createDataFrame(rows, "name string, block long, offset long, sha1 binary, grp string").cache()


def key(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("words", [1, 2, 16])
def test_sliced_index_finds_the_same(features, words):
    named = features.where("grp is not null")
    built = index.build_index(named, "grp", mask=MASK)
    sliced = index.build_sliced(features, "grp", mask=MASK, words=words)
    expected = key(index.probe_index(named, built, mask=MASK))
    assert key(sliced.probe(named)) == expected and len(expected) > 1000
    assert key(index.slice_index(built, mask=MASK, words=words).bits) == key(sliced.bits)
    assert sliced.bits.select("part").distinct().count() == -(-150 // (64 * words))
    assert key(sliced.search(named, hits=2)) == key(index.index_search(named, built, hits=2, mask=MASK))
    assert sliced.probe(features.limit(0)).count() == 0
    assert index.build_sliced(features.limit(0), "grp", mask=MASK).probe(features).count() == 0


def test_saved_slices_are_probed_where_they_lie(spark, features, tmp_path):
    made = index.build_sliced(features, "grp", mask=MASK, words=4)
    before = key(made.probe(features))
    made.save("sliced_for_test", buckets=4)
    try:
        again = index.SlicedIndex.load(spark, "sliced_for_test")
        assert again.mask == MASK and key(again.probe(features)) == before
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = features.select(F.col("offset").alias("bit")).join(again.bits, "bit")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(bit") == 1  # of the probe's bits only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("sliced_for_test", "sliced_for_test_sets"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_counts_equal_insertion_in_order(features):
    named = features.where("grp is not null")
    for mask in (MASK, 63, (1 << 29) - 1):
        filters = {}
        for r in sorted(named.collect(), key=lambda r: (r.name, r.block, r.offset)):
            one = filters.setdefault(r.grp, kernel.Filter((mask + 1) // 8))
            one.count += one.add(kernel.positions(r.sha1))
        found = {r.index_set: r.elements for r in index.counted_elements(named, "grp", mask=mask).collect()}
        assert found == {name: one.count for name, one in filters.items()}


def test_index_files_have_true_counts(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"f{i}", rng.integers(0, 256, 30_000).astype(np.uint8).tobytes()) for i in range(3)]
    objects = spark.createDataFrame([*rows, ("copy", rows[0][1])], "name string, content binary")
    found = digest.features(objects, block_size=16 << 10).cache()
    index_file.write_indexes(found, objects, "known", str(tmp_path / "idx"), limit=60_000)
    names = sorted(os.listdir(tmp_path / "idx"))
    assert names == ["known0.idx", "known1.idx"]  # by name: copy and f0, f1 and f2
    counts = dict(r for r in index_file.read_indexes(spark, str(tmp_path / "idx")).select("index_set", "elements").distinct().collect())
    sizes = {r.name: r.n for r in found.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert counts == {"known0": sizes["f0"], "known1": sizes["f1"] + sizes["f2"]}


def visible(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_files_are_written_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", None)], "name string, content binary")
    folder = tmp_path / "out"
    file_sink.write_files(rows.repartition(3), str(folder))
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {"a": b"1", "b": b"2", "c": b""}
    for bad in (rows.union(rows).repartition(4, "content"), rows.withColumn("name", F.lit("../x")), rows.withColumn("name", F.concat("name", F.when(F.col("name") == "c", F.raise_error(F.lit("no"))).otherwise(F.lit("2"))))):
        with pytest.raises(Exception):
            file_sink.write_files(bad.union(rows), str(folder))
        assert visible(folder) == ["a", "b", "c"]
    file_sink.write_files(rows.where("name = 'b'").union(rows.where("name = 'b'")).coalesce(1), str(folder), overwrite=True)
    assert {n: (folder / n).read_bytes() for n in visible(folder)} == {"b": b"22"}


FAILS_ONCE = """
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from kindred.sources.file_sink import write_files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def late(batches):
    from pyspark import TaskContext
    for batch in batches:
        yield batch
        if TaskContext.get().attemptNumber() == 0:
            seen = [f for f in os.listdir(sys.argv[1]) if not f.startswith(".")] if os.path.isdir(sys.argv[1]) else []
            assert not seen, seen
            raise RuntimeError("lost")
rows = spark.range(6, numPartitions=3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), 1000).cast("binary").alias("content"))
write_files(rows.mapInArrow(late, "name string, content binary"), sys.argv[1])
"""


def test_a_task_that_fails_once_leaves_nothing_behind(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(FAILS_ONCE)
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, str(script), str(tmp_path / "out")], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert visible(tmp_path / "out") == [f"f{i}" for i in range(6)]


def read_stream(spark, folder, tmp_path, **options):
    rows = segments.stream_segments(spark, str(folder), segment=2000, **options)
    rows = rows.select(F.element_at(F.split("name", "/"), -1).alias("name"), "start", F.length("content").alias("n"), F.md5("content").alias("md5"))
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return sorted((r["name"].split(".")[0], r["start"], r["n"], r["md5"]) for r in spark.read.parquet(str(tmp_path / "rows")).collect())


def test_segments_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = np.random.default_rng(6).integers(0, 256, 9000).astype(np.uint8).tobytes()
    part = lambda name, a, b: (name, a, b - a, hashlib.md5(data[a:b]).hexdigest())
    (folder / "a").write_bytes(data[:5000])
    (folder / "b").write_bytes(data[:100])  # too small
    (folder / "c").write_bytes(data[:2300])  # a rest of 300 bytes goes with the segment before
    first = [part("a", 0, 2000), part("a", 2000, 4000), part("a", 4000, 5000), part("c", 0, 2300)]
    assert read_stream(spark, folder, tmp_path, settle_seconds=0) == first
    batch = segments.read_segments(spark, str(folder), segment=2000).collect()
    assert sorted((r["start"], len(r["content"])) for r in batch) == sorted((a, n) for _, a, n, _ in first)
    # a restart reads what came since: a new file and the growth of another
    (folder / "d").write_bytes(data[:1000])
    (folder / "a").write_bytes(data)
    second = sorted([*first, part("a", 5000, 7000), part("a", 7000, 9000), part("d", 0, 1000)])
    assert read_stream(spark, folder, tmp_path, settle_seconds=0) == second
    assert read_stream(spark, folder, tmp_path, settle_seconds=0) == second


def test_a_growing_file_waits_with_its_rest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = np.random.default_rng(7).integers(0, 256, 9000).astype(np.uint8).tobytes()
    (folder / "a").write_bytes(data[:4900])
    assert [x[1:3] for x in read_stream(spark, folder, tmp_path, settle_seconds=1000)] == [(0, 2000), (2000, 2000)]
    (folder / "a").write_bytes(data[:8400])  # the last whole segment may get a rest of 400 bytes
    assert [x[1:3] for x in read_stream(spark, folder, tmp_path, settle_seconds=1000)][2:] == [(4000, 2000)]
    old = time.time() - 5000
    os.utime(folder / "a", (old, old))
    assert [x[1:3] for x in read_stream(spark, folder, tmp_path, settle_seconds=1000)][3:] == [(6000, 2400)]


def test_narrow_indexes_are_probed_as_matrices(spark, monkeypatch):
    """Where most parts have rows of each bit, nothing is written for features times parts; the sets found are the same."""
    rows = [(f"n{i}", i % 3, i, f"s{i % 70:02d}", i if i % 9 else None) for i in range(400)]
    features = spark.createDataFrame(rows, "name string, block long, offset long, grp string, k int").withColumn("sha1", F.unhex(F.sha1(F.col("k").cast("string"))))
    made = index.build_sliced(features, "grp", mask=511, words=1)
    monkeypatch.setattr(index, "_FEATURES", 150)
    monkeypatch.setattr(index, "_PARTS", 4096)
    found = made.probe(features)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    key = lambda df: sorted(tuple(r) for r in df.select("name", "block", "offset", "index_set").collect())
    narrow = key(found)
    monkeypatch.setattr(index, "_MATRIX", 0)
    assert narrow == key(made.probe(features)) and len(narrow) > 300
    assert narrow == key(index.probe_index(features.where("sha1 is not null"), index.build_index(features.where("sha1 is not null"), "grp", mask=511), mask=511))


def test_search_by_rows_of_bits_equals_search_of_bitmaps(spark, monkeypatch):
    """index_search of the queries builds no bitmap; features are computed once for the sets and once for what is asked."""
    rows = [(f"n{i}", i % 2, i, f"s{i % 5}") for i in range(300)]
    features = spark.createDataFrame(rows, "name string, block long, offset long, grp string").withColumn("name", F.concat(F.lit("o"), F.col("offset") % 7)).withColumn("sha1", F.unhex(F.sha1(F.col("offset").cast("string"))))
    made = index.build_sliced(features, "grp", words=1)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(made.search(features, hits=0)) == key(index.index_search(features, index.build_index(features, "grp"), hits=0)) != []
    from kindred.plans import queries

    monkeypatch.setattr(queries.index, "build_index", None)
    assert queries.index_search(spark, "/root/testdata/sf0.001").columns == ["name", "block", "index_set", "hits"]
