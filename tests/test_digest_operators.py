import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import columns as c
from kindred.functions import tables as t
from kindred.operators import compare, digest, filters, index, segments
from kindred.plans.catalog import BusySet, SetCatalog, UnknownSet
from kindred.plans.options import Options, UnknownOption
from kindred.sources import digest_text, files, index_file, large_file
from kindred.streaming import ingest


def blob(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def objects(spark):
    base = blob(1, 40_000)
    rows = [("a:b", base), ("copy é", base), ("part", blob(2, 9000) + base[5000:25_000]), ("other", blob(3, 30_000)), ("tiny", b"x" * 511), ("flat", b"x" * 600), (None, blob(4, 2000)), ("null", None)]
    return spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "name string, content binary, n int, filters string")


def test_digest_and_compare(spark, objects):
    made = digest.digest(objects).cache()
    rows = {r["name"]: r for r in made.collect()}
    assert set(rows) == {"a:b", "copy é", "part", "other", "flat", None}
    assert rows["a:b"]["filters"] == rows["copy é"]["filters"] and rows["flat"]["bf_count"] == 1
    for r in rows.values():
        for f in r["filters"]:
            assert f["hamming"] == sum(bin(w & (1 << 64) - 1).count("1") for w in f["words"])
    numbered = made.withColumn("digest_id", F.xxhash64("name"))
    few = {frozenset((r["query"], r["target"])): r["score"] for r in compare.compare_all(numbered, tile=2).collect()}
    one = {frozenset((r["query"], r["target"])): r["score"] for r in compare.compare_all(numbered).collect()}
    assert few == one and few[frozenset(("a:b", "copy é"))] == 100 and few[frozenset(("a:b", "part"))] > 30
    assert frozenset(("a:b", "other")) not in few
    both = {(r["query"], r["target"]): r["score"] for r in compare.compare_to(made, made, threshold=-1, tile=3).collect()}
    assert len(both) == 36 and both["a:b", "part"] == both["part", "a:b"]
    assert {(r["query"], r["target"]) for r in compare.compare_to(made, made, fast=True).collect()} >= {("a:b", "copy é")}
    assert compare.compare_all(numbered.limit(0)).count() == 0
    lines = compare.comparison_lines(spark.createDataFrame([("q", "t", 7), ("q", "u", -1)], "query string, target string, score int"), "tab")
    assert sorted(r[0] for r in lines.collect()) == ["q\tt\t007", "q\tu\t-1"]


def test_score_grows_with_the_shared_fragment(spark):
    """The two-blob experiment: more of a fragment in common, a higher score."""
    rows = []
    for k, kb in enumerate((4, 16, 64, 128)):
        frag = blob(100 + k, kb << 10)
        for side in (0, 1):
            whole = bytearray(blob(200 + 2 * k + side, 256 << 10))
            at = int(np.random.default_rng(300 + 2 * k + side).integers(0, (256 - kb) << 10))
            whole[at : at + len(frag)] = frag
            rows.append((f"{kb}-{side}", bytes(whole)))
    made = digest.digest(spark.createDataFrame(rows, "name string, content binary")).withColumn("digest_id", F.xxhash64("name"))
    found = {r["query"].split("-")[0]: r["score"] for r in compare.compare_all(made, threshold=0).collect() if r["query"].split("-")[0] == r["target"].split("-")[0]}
    scores = [found[str(kb)] for kb in (4, 16, 64, 128)]
    assert scores == sorted(scores) and scores[-1] >= 4 * scores[0] > 0


@pytest.mark.parametrize("block", [0, 4096])
def test_text_round_trip(spark, objects, block):
    made = digest.digest(objects.where("name is not null"), block_size=block)
    lines = made.select(digest_text.digest_line().alias("value")).cache()
    assert all("\n" not in r[0] and "\r" not in r[0] for r in lines.collect())
    back = digest_text.parse_digests(lines)
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    broken = lines.union(spark.createDataFrame([("sdbf:03:1:a:" + "x" * 400,), ("",), (None,), ("junk",)], "value string"))
    assert digest_text.parse_digests(broken, invalid="drop").count() == lines.count()
    seen = digest_text.validate(broken).first()
    assert seen["valid"] == lines.count() and seen["lines"] == lines.count() + 2
    with pytest.raises(Exception, match="InvalidDigest"):
        digest_text.parse_digests(broken).collect()


def test_stream_line_format(objects):
    line = digest.digest(objects.where("name = 'copy é'")).select(digest_text.digest_line()).first()[0]
    parts = line.split(":")
    assert parts[:11] == ["sdbf", "03", "7", "copy é", "40000", "sha1", "256", "5", "7ff", "160", parts[10]]
    assert len(parts[12]) == -(-int(parts[10]) * 256 // 3) * 4


def test_features_and_index(spark, objects):
    named = objects.where("name is not null")
    found = digest.features(named, block_size=4096)
    built = index.build_index(found.where("name = 'a:b'"), F.lit("known")).cache()
    hits = {r["name"] for r in index.index_search(found, built).collect()}
    assert hits == {"a:b", "copy é", "part"}
    probed = index.probe_index(found.where("name = 'copy é'"), built)
    assert probed.count() == found.where("name = 'copy é'").select("block", "offset").distinct().count()
    assert index.merge_indexes(built.union(built)).count() == built.count()
    assert index.index_search(found.limit(0), built).count() == 0


def test_index_file_round_trip(spark, objects, tmp_path):
    mask = (1 << 20) - 1
    built = index.build_index(digest.features(objects.where("name = 'a:b'")), F.lit("set"), mask=mask)
    row = index_file.export_index(built, size=1 << 17).first()
    (tmp_path / "set.idx").write_bytes(row["file"])
    back = index_file.read_indexes(spark, str(tmp_path))
    key = lambda df: sorted((r["index_set"], r["bucket"], bytes(r["bitmap"])) for r in df.collect())
    assert key(back) == key(built)
    with pytest.raises(index_file.InvalidIndex):
        index_file.unpack_index(b"nothing")


def test_large_digests_round_trip(spark, objects, tmp_path):
    made = digest.large_digest(objects.where("name is not null"))
    (tmp_path / "x.sdbflg").write_bytes(b"".join(r["file"] for r in large_file.export_large(made).collect()))
    back = large_file.read_large(spark, str(tmp_path / "x.sdbflg"))
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    assert any(r[0].startswith("a:b size 40000 filter count 1") for r in large_file.large_details(back).collect())
    scores = compare.compare_large(made.withColumn("digest_id", F.xxhash64("name")), threshold=0).collect()
    assert len(scores) == 10
    with pytest.raises(large_file.InvalidLargeDigest):
        list(large_file.unpack_large(b"\xff\x00\x00\x00abc"))


def test_filters_as_columns(spark):
    rows = spark.createDataFrame([("g", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("g", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("h", None)], "grp string, sha1 string")
    built = filters.build_filters(rows, "grp").collect()
    assert [(r["grp"], r["elements"]) for r in built] == [("g", 1)]
    bits = {64 * i + b for i, w in enumerate(built[0]["words"]) for b in range(64) if w >> b & 1}
    assert bits == {425, 1607, 1722, 120, 156}
    assert {r["bit"] for r in filters.fold_bits(filters.bits_of(rows, "grp"), 64).collect()} == {b % 512 for b in bits}
    with pytest.raises(ValueError):
        filters.build_filters(rows, "grp", size=100)
    words = spark.createDataFrame([([-1] * 32, [1] * 32, [5] * 64)], "a array<bigint>, b array<bigint>, l array<bigint>")
    row = words.select(c.hamming(F.col("a")).alias("h"), c.overlap(F.col("a"), F.col("b")).alias("o"), c.fast(F.col("a")).alias("f"), c.union(F.col("a"), F.col("l")).alias("u"), c.fold(F.col("l"), 64, 5).alias("fold"), c.match_estimate(2048, 5, F.lit(160), F.lit(160), F.lit(0)).alias("m")).first()
    assert (row["h"], row["o"], row["f"], row["u"], len(row["fold"]), row["m"]) == (2048, 32, [-1] * 8, None, 32, 214)


def test_plans(spark):
    sizes = spark.createDataFrame([("a", 511), ("b", 512), ("c", 2048), ("d", 2560), ("e", 2561), ("f", 4096), ("g", 4097), ("n", None)], "name string, size bigint")
    plan = {}
    for r in segments.plan_segments(sizes, segment=2048).orderBy("name", "segment").collect():
        plan.setdefault(r["name"], []).append((r["start"], r["length"]))
    assert plan["d"] == [(0, 2560)] and plan["e"] == [(0, 2048), (2048, 513)] and plan["f"] == [(0, 2048), (2048, 2048)] or plan["f"] == [(0, 4096)]
    assert sum(n for _, n in plan["g"]) == 4097
    blocks = {r["name"]: r["n"] for r in segments.plan_blocks(sizes, block=1024).groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert blocks == {"b": 1, "c": 2, "d": 3, "e": 3, "f": 4, "g": 4}
    batches = [r["batch"] for r in segments.plan_batches(sizes, limit=3000).orderBy("name").collect()]
    assert batches == [0, 0, 0, 1, 1, 2, 4, 5]
    cases = spark.createDataFrame([(100,), (1 << 25,)], "size bigint")
    assert [tuple(r) for r in cases.select(c.block_kib(F.col("size")), c.block_kib(F.col("size"), 0), c.block_kib(F.col("size"), 99), c.block_kib(F.col("size"), -5)).collect()] == [(0, 0, 16, 0), (16, 0, 16, 16)]


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "big").write_bytes(blob(1, 700))
    (tmp_path / "d" / "small").write_bytes(b"x")
    (tmp_path / "d" / "e" / "deep").write_bytes(blob(2, 700))
    (tmp_path / "list").write_text(f"{tmp_path}/d/e/deep\n{tmp_path}/missing\n")
    (tmp_path / "hex").write_text("a9993e364706816aba3e25717850c26c9cd0d89d\nno\n")
    assert files.read_objects(spark, str(tmp_path / "d")).count() == 1
    assert files.read_objects(spark, str(tmp_path / "d"), recursive=True).count() == 2
    assert files.list_files(spark, str(tmp_path / "d")).count() == 3
    assert files.read_target_list(spark, str(tmp_path / "list"), str(tmp_path / "d")).count() == 1
    assert files.read_hex_digests(spark, str(tmp_path / "hex")).count() == 1
    from kindred.sources.segments import SegmentSource

    spark.dataSource.register(SegmentSource)
    (tmp_path / "long").write_bytes(blob(5, 5000))
    rows = spark.read.format("segments").option("path", str(tmp_path / "long")).option("segmentBytes", "2000").load().orderBy("start").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == blob(5, 5000) and len(rows) == 3


def test_catalog(spark, objects, tmp_path):
    catalog = SetCatalog(spark, str(tmp_path / "catalog"))
    assert catalog.set_list().count() == 0
    one = catalog.hash_objects("one", objects.where("name is not null"))
    catalog.export_set(one, str(tmp_path / "export"))
    two = catalog.load_set(str(tmp_path / "export"))
    assert catalog.set_name(two) == "export" and catalog.set_name(5) == ""
    assert [r["items"] for r in catalog.set_list().collect()] == [5, 5]
    job = catalog.compare_all(one, user="u")
    other = catalog.compare_two(one, two, user="v")
    assert catalog.wait(other).startswith("complete") and catalog.wait(job) == catalog.result_status(job)
    assert catalog.result_status(job) == f"complete ({catalog.result(job).count()} lines)"
    assert catalog.result_info(other) == "one -- export" and catalog.result_duration(job).endswith("s")
    assert [r["result_id"] for r in catalog.results_list("u").collect()] == [job]
    assert catalog.remove_result(job) and not catalog.remove_result(job) and catalog.result_status(job) == "not found"
    with pytest.raises(UnknownSet):
        catalog.digests(1)
    catalog.append_set(two, one)
    catalog.append(two, digest.digest(objects.where("name = 'part'")))
    grown = catalog.digests(two)
    assert grown.count() == 11 and grown.select("digest_id").distinct().count() == 11
    # rows of one name, size and number of filters are digests of their own
    base = blob(9, 30_000)
    same = spark.createDataFrame([("x", base), ("x", base[:29_000] + blob(10, 1000)), ("a", base)], "name string, content binary")
    twins = catalog.hash_objects("twins", same)
    job = catalog.compare_all(twins)
    assert catalog.wait(job, 300).startswith("complete")
    found = catalog.result(job).collect()
    assert sorted((r["query"], r["target"]) for r in found) == [("a", "x"), ("a", "x"), ("x", "x")] and all(r["score"] > 80 for r in found)
    (tmp_path / "folder").mkdir()
    lines = [r[0] for r in catalog.display_contents(one).collect()]
    (tmp_path / "folder" / "first.sdbf").write_text("\n".join(lines) + "\n")
    (tmp_path / "folder" / "notes.txt").write_text("no digest\n")
    known = index_file.export_index(index.build_index(digest.features(objects.where("name = 'a:b'"), block_size=16 << 10), F.lit("k"))).first()["file"]
    (tmp_path / "folder" / "first.sdbf.idx").write_bytes(bytes(known))
    loaded = catalog.load_folder(str(tmp_path / "folder"))
    assert list(loaded) == ["first"] and catalog.digests(loaded["first"]).count() == 5
    assert {r["index_set"] for r in catalog.hash_or_search("", objects.where("name is not null"), level=3).collect()} == {"first"}
    assert catalog.search(objects.where("name is not null"), level=1).count() == 0
    catalog.index_objects("known", objects.where("name = 'a:b'"))
    assert catalog.search(objects.where("name is not null")).count() > 0
    assert catalog.display_contents(one).count() == 5 and catalog.display_set(one).count() == 5


def test_filters_as_lines(spark, objects, tmp_path):
    made = digest.digest(objects.where("name = 'a:b'"))
    rows = made.select(F.explode("filters").alias("f")).select(digest_text.filter_line(F.col("f.words"), F.col("f.elem_count"), F.lit("set")).alias("value"), "f")
    back = digest_text.parse_filters(rows.select("value")).collect()
    assert sorted((tuple(r["words"]), r["elem_count"], r["hamming"], r["name"], r["mask"]) for r in back) == sorted((tuple(f["words"]), f["elem_count"], f["hamming"], "set", 2047) for f in made.first()["filters"])
    large = spark.createDataFrame([(list(range(-128, 128)),)], "w array<bigint>").select(digest_text.filter_line(F.col("w"), F.lit(7), F.lit("x"), 16383).alias("value"))
    for folds, size in ((0, 256), (1, 128), (2, 64), (9, 32)):
        words = list(range(-128, 128))
        while len(words) > size:
            words = [a | b for a, b in zip(words[: len(words) // 2], words[len(words) // 2 :], strict=True)]
        assert digest_text.parse_filters(large, folds=folds).first()["words"] == words
    (tmp_path / "one.sdbf").write_text("\n".join(r[0] for r in made.select(digest_text.digest_line()).collect()) + "\n")
    assert [(r["index_set"], r["name"]) for r in digest_text.read_sets(spark, str(tmp_path)).collect()] == [("one", "a:b")]


def test_functions_in_sql(spark, objects):
    from kindred.functions import udf

    udf.register(spark)
    objects.createOrReplaceTempView("udf_objects")
    rows = spark.sql("SELECT name, content, digest_filters(content) AS f FROM udf_objects WHERE name IS NOT NULL")
    rows.createOrReplaceTempView("udf_digests")
    made = {r["name"]: r["filters"] for r in digest.digest(objects).collect() if r["name"]}
    assert {r["name"]: r["f"] for r in rows.collect() if r["f"]} == made
    scores = spark.sql("SELECT a.name AS x, b.name AS y, digest_score(a.name, a.f, b.name, b.f) AS s FROM udf_digests a JOIN udf_digests b ON a.name < b.name").collect()
    known = {frozenset((r["query"], r["target"])): r["score"] for r in compare.compare_to(digest.digest(objects), digest.digest(objects), threshold=-1).collect()}
    assert {(r["x"], r["y"]) for r in scores if r["s"] is None} >= {("other", "tiny")}
    assert all(known[frozenset((r["x"], r["y"]))] == r["s"] for r in scores if r["s"] is not None)
    found = spark.sql("SELECT name, count(*) AS n FROM udf_objects, LATERAL digest_features(content) GROUP BY name").collect()
    expected = {r["name"]: r["n"] for r in digest.features(objects).groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert {r["name"]: r["n"] for r in found} == expected


def test_options(tmp_path):
    (tmp_path / "cfg").write_text("threshold=5\nfast = yes # quick\n\n")
    options = Options.load(str(tmp_path / "cfg"), threshold=9)
    assert options.threshold == 9 and options.fast
    with pytest.raises(UnknownOption):
        Options.load(thread_count=3)


def test_streams(spark, objects, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("x", "y"):
        (tmp_path / "in" / name).write_bytes(blob(1, 40_000))
    known = digest.digest(objects.where("name = 'a:b'"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"))
    ingest.append_digests(ingest.digest_stream(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    ingest.compare_stream(ingest.digest_stream(stream), known, str(tmp_path / "hits"), str(tmp_path / "log2")).awaitTermination()
    assert [r["score"] for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [100, 100]
    built = index.build_index(digest.features(objects.where("name = 'a:b'"), block_size=4096), F.lit("k"))
    ingest.search_stream(stream, built, str(tmp_path / "found"), str(tmp_path / "log3"), block_size=4096).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "found")).count() > 0
    segments_ = ingest.segment_stream(stream, segment=20_000, block_size=4096)
    ingest.append_digests(segments_, str(tmp_path / "seg"), str(tmp_path / "log4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seg")).count() == 4


def test_fitted_ranks_follow_the_corpus(spark, objects):
    ranks = digest.fit_ranks(objects)
    assert sorted(ranks[1:1000]) == list(range(1, 1000)) and ranks[0] == ranks[1000] == 0
    assert t.check_ranks(ranks) is not None


def test_tiles_give_the_same_pairs_as_one(spark):
    rng = np.random.default_rng(8)
    base = [blob(70 + i, int(rng.integers(600, 60_000))) for i in range(6)]
    rows = [(f"{'zyx'[i % 3]}{i}", base[i % 6] + blob(90 + i, 3000 * (i % 4)), 40 - i) for i in range(24)]
    made = digest.digest(spark.createDataFrame(rows, "name string, content binary, k long")).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "name string, digest_id long"), "name")
    one = sorted(map(tuple, compare.compare_all(made, threshold=-1).collect()))
    assert len(one) == 24 * 23 // 2 and one == sorted(map(tuple, compare.compare_all(made, threshold=-1, tile=5).collect()))
    ids = {r[0]: r[2] for r in rows}
    assert all(ids[q] < ids[t] for q, t, _ in one)
    every = {(r["query"], r["target"]): r["score"] for r in compare.compare_to(made, made, threshold=-1).collect()}
    assert all(every[q, t] == s for q, t, s in one)


def test_jobs_in_the_background(spark, objects, tmp_path):
    """A job's status goes from processing to complete or failed; removing it interrupts it."""
    import time

    catalog = SetCatalog(spark, str(tmp_path / "jobs"))
    gate = tmp_path / "gate"

    def slow(rows):
        def run(batches):
            for batch in batches:
                while not gate.exists():
                    time.sleep(0.05)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    rows = spark.range(3).selectExpr("CAST(id AS string) AS query")
    started = time.time()
    job = catalog._run("u", "slow", lambda: slow(rows))
    assert time.time() - started < 5 and catalog.result_status(job) == catalog.wait(job, 0.5) == "processing"
    gate.touch()
    assert catalog.wait(job, 120) == "complete (3 lines)" and catalog.result(job).count() == 3
    gate.unlink()
    failed = catalog._run("u", "broken", lambda: rows.select(F.raise_error(F.lit("no good"))))
    assert catalog.wait(failed, 120).startswith("failed: ") and "no good" in catalog.result_status(failed)
    endless = catalog._run("u", "endless", lambda: slow(rows))
    time.sleep(2)
    started = time.time()
    assert catalog.remove_result(endless) and catalog.result_status(endless) == "not found"
    assert time.time() - started < 30 and spark.range(10).count() == 10  # other jobs go on
    gate.touch()
    # jobs whose driver has died
    lost = f"jobs/result_id=7/job.json"
    catalog._put(lost, catalog._get(f"jobs/result_id={job}/job.json") | {"application": "gone", "ended": None, "lines": None})
    assert catalog.result_status(7) == "processing" and catalog.fail_orphans() == 1
    assert catalog.result_status(7) == "failed: its driver has ended" and catalog.fail_orphans() == 0


def test_a_set_is_added_to_by_one_at_a_time(spark, objects, tmp_path):
    catalog = SetCatalog(spark, str(tmp_path / "busy"))
    one = catalog.hash_objects("one", objects.where("name is not null"))
    with catalog._alone(one), pytest.raises(BusySet):
        catalog.append_set(one, one)
    assert catalog.digests(one).count() == 5
    catalog.append_set(one, one)
    assert catalog.digests(one).select("digest_id").distinct().count() == 10


def test_declared_sizes(spark):
    """A digest over the declared size, zeros behind what there is, with the size of what there is."""
    data = blob(11, 9000)
    rows = spark.createDataFrame([("more", data, 20_000), ("less", data, 4000), ("same", data, 9000), ("few", data, 100), ("tiny", data[:300], 9000), (None, data, 9000), ("null", None, 900)], "name string, content binary, size int")
    for block in (0, 4096):
        made = {r["name"]: r for r in digest.digest_declared(rows, "size", block_size=block).collect()}
        assert set(made) == {"more", "less", "same", None}
        plain = spark.createDataFrame([("more", data + bytes(11_000)), ("less", data[:4000]), ("same", data)], "name string, content binary")
        for r in digest.digest(plain, block_size=block).collect():
            assert made[r["name"]]["filters"] == r["filters"] and made[r["name"]]["bf_count"] == r["bf_count"]
        assert [made[n]["input_size"] for n in ("more", "less", "same")] == [9000, 4000, 9000]


def test_a_set_ends_at_an_empty_line(spark, objects, tmp_path):
    lines = [r[0] for r in digest.digest(objects.where("name is not null")).select(digest_text.digest_line()).collect()]
    (tmp_path / "a").write_text("\n".join([lines[0], lines[1], "", lines[2], "", lines[3]]) + "\n")
    (tmp_path / "b").write_text("\n".join(lines[2:4]))
    (tmp_path / "c").write_text("\n" + lines[0])
    found = sorted(r["name"] for r in digest_text.read_digests(spark, str(tmp_path)).collect())
    assert found == sorted(line.split(":", 4)[3] if "a:b" not in line else "a:b" for line in lines[:4])
    assert digest_text.read_digests(spark, str(tmp_path), to_blank=False).count() == 7
    # a file that is read in many parts
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "x").write_text("\n".join(lines * 50 + [""] + lines * 50 + [""] + lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        read = digest_text.read_digests(spark, str(tmp_path / "long"))
        assert read.rdd.getNumPartitions() > 1 and read.count() == 50 * len(lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_digests_that_have_come_before(spark, tmp_path):
    """Copies are dropped across batches and a restart; after the delay a digest is new again."""
    rows = [("a", blob(31, 9000), 0), ("b", blob(32, 9000), 10), ("a again", blob(31, 9000), 20), ("a later", blob(31, 9000), 7000), ("c", blob(33, 9000), 20_000), ("b late", blob(32, 9000), 20_010)]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "name string, content binary, at timestamp"

    def run(part, number):
        df = spark.createDataFrame(part, "name string, content binary, s long").select("name", "content", F.timestamp_seconds(F.col("s") + 86400).alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        digests = digest.digest(source.withColumn("name", F.concat_ws("|", "name", F.unix_timestamp("at"))))
        digests = digests.withColumn("at", F.timestamp_seconds(F.element_at(F.split("name", "\\|"), -1).cast("long")))
        ingest.append_digests(ingest.first_digests(digests, "at", delay="1 hour").drop("content_key"), out, str(tmp_path / "log")).awaitTermination()
        return sorted(r["name"].split("|")[0] for r in spark.read.parquet(out).collect())

    assert run(rows[:2], 1) == ["a", "b"]
    assert run(rows[2:3], 2) == ["a", "b"]
    assert run(rows[4:5], 3) == ["a", "b", "c"]
    assert run(rows[5:], 4) == ["a", "b", "b late", "c"]


def test_pairs_write_nothing(spark):
    """Digests aren't sent once for each tile of the other side, and those without a number are in no pair of a set."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    rows = [(f"o{i}", data[i * 100 :] if i % 2 else data[:2000] + rng.integers(0, 256, 900).astype(np.uint8).tobytes()) for i in range(9)]
    made = digest.digest(spark.createDataFrame(rows, "name string, content binary"))
    numbered = made.withColumn("digest_id", F.when(F.col("name") != "o3", F.substring("name", 2, 9).cast("long")))
    found = compare.compare_all(numbered, threshold=-1, tile=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan
    pairs = {(r["query"], r["target"]): r["score"] for r in found.collect()}
    assert set(pairs) == {(f"o{i}", f"o{j}") for i in range(9) for j in range(i + 1, 9) if 3 not in (i, j)}
    every = {(r["query"], r["target"]): r["score"] for r in compare.compare_to(made, made, threshold=-1).collect()}
    assert len(every) == 81 and all(every[p] == s for p, s in pairs.items())


def test_words_of_large_digests_are_handled_as_arrays():
    """A thousand filters of 16 KB in seconds, byte for byte as the format says; words packed, one by one, or cut off."""
    rng = np.random.default_rng(8)
    row = {"name": "o", "file_size": 9, "filters": [{"bf_size": 16384, "max_elem": 8738, "elem_count": 7, "words": rng.integers(-(1 << 63), 1 << 63, 2048)} for _ in range(1000)]}
    begin = time.process_time()
    made = large_file.pack_large(row)
    (back,) = large_file.unpack_large(made)
    assert time.process_time() - begin < 4
    assert back["name"] == "o" and all((a["words"] == b["words"]).all() and a["elem_count"] == 7 for a, b in zip(back["filters"], row["filters"], strict=True))
    one = b"".join(b"\x31" + struct.pack("<q", w) for w in row["filters"][0]["words"].tolist())
    assert one in made
    for words, whole in ((one[:9], True), (b"\x32\x10" + struct.pack("<2q", -1, 5), True), (one[:9] + b"\x08\x05" + one[9:18], True), (one[:-1], False), (b"\x32\x07" + one[:7], False)):
        data = large_file._frame(large_file._message([(1, 1), (2, "o"), (4, 9)])) + large_file._frame(words)
        if whole:
            (found,) = large_file.unpack_large(data)
            assert found["filters"][0]["words"].tolist() == ([-1, 5] if words[0] == 0x32 else row["filters"][0]["words"].tolist()[: len(words) // 9])
        else:
            with pytest.raises(large_file.InvalidLargeDigest):
                list(large_file.unpack_large(data))
