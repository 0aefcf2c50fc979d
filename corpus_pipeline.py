"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the shared folder and hands it on. All but the last return
the columns of `documents`, of what they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, jaccard, linededup, packing, quality
from kindred.llm.queries import tokenizer_path
from kindred.llm.spark import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it learns from labelled ones that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs.where(~quality.held_out()), labels)
    return _documents(docs.where(quality.quality_score(spark, model)("text") >= 0.7))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones make superfluous.

    A document all of whose lines go has nothing of its own and goes too; one that
    had no text from the start stays.
    """
    had = docs.withColumn("__had", F.length("text") > 0)
    left = linededup.drop_lines(had)
    left = left.where(~F.coalesce(F.col("__had") & ~F.col("text").rlike(r"\S"), F.lit(False)))
    return _documents(left.withColumn("n_chars", F.length("text").cast("long")))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest doc_id."""
    return _documents(jaccard.keep_one(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no whole window of a benchmark item stands, nor two items of fewer words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leak = decontam.leaks(spark, benchmark, F.col("text"))
    return _documents(docs.where(~leak))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on `documents`, each written as Parquet into the shared folder and read again; the tables go when the driver's Python ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
