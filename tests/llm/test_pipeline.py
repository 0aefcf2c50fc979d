import zlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kindred.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_act(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == list(pipeline.COLUMNS)
            kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3]
    good, bad = {i for i, q in labels.items() if q}, {i for i, q in labels.items() if not q}
    assert len(good & kept[0]) > 0.97 * len(good) and len(bad & kept[0]) < 0.05 * len(bad)
    lengths = docs.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert lengths[0] <= 2048 * lengths[1]


def test_one_of_similar_and_contaminated(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(2).collect()
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (2, long), (3, long.replace("w100 ", "x ")), (3, long.replace("w100 ", "x ")), (4, "other words stand here alone"), (5, item[0]["text"]), (6, item[0]["text"] + " " + item[1]["text"]), (7, None), (None, "no id here"), (8, "twice"), (8, "twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = sorted(r["doc_id"] or 0 for r in pipeline.keep_one_of_similar(spark, docs, DATA).collect())
    assert one == [0, 1, 4, 5, 6, 7, 8]
    clean = {r["doc_id"] for r in pipeline.drop_contaminated(spark, docs, DATA).collect()}
    assert clean == {1, 2, 3, 4, 7, 8, None}
    lines = spark.createDataFrame([(1, "a line\nof text", "", "", 0), (2, "a line", "", "", 0), (3, "", "", "", 0), (4, None, "", "", 0), (5, "new\na line", "", "", 0)], docs.schema)
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.drop_repeated_lines(spark, lines, DATA).collect()}
    assert left == {1: ("a line\nof text", 14), 3: ("", 0), 4: (None, None), 5: ("new", 3)}


def test_run_equals_its_stages(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    found = pipeline.run(spark, small).toPandas()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert len(found) > 0 and sorted(found[pieces].itertuples(index=False, name=None)) == sorted(docs.toPandas()[pieces].itertuples(index=False, name=None))
    assert found.groupby("sequence_id").length.sum().max() <= 2048


def test_folds(spark):
    """Training leaves out the rows whose crc32 has the remainder that contracts name."""
    rows = spark.range(-50, 200).select(F.col("id").alias("doc_id"), quality.held_out().alias("h"), quality.held_out(of=7).alias("h7")).collect()
    crc = lambda r: zlib.crc32(str(r.doc_id).encode())
    assert all(r.h == (crc(r) % 4 == 2) and r.h7 == (crc(r) % 7 == 2) for r in rows)
    assert set(queries.oracle_sql()) <= set(queries.queries())
