"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class has a Gaussian over transformed statistics of whole texts. Its
covariance is shrunk towards the pooled diagonal, which keeps it regular for
rare classes, and its Cholesky factor is computed once and sent to the tasks. A
score is the logistic of the difference of the Mahalanobis log-densities and
priors. Only means and covariances of the statistics, of a fixed number, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark import likely
from .text import VISIBLE, Words, column_bytes, slices

STATISTICS = ("length", "word_length", "capitals", "exclamations", "marks", "bars", "stops", "digits", "echoes", "variety", "lines")

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = 1
_KIND[ord("!")] = 2
for _c in b"#$%&*+/<=>@\\^_`~{}[]":
    _KIND[_c] = 3
_KIND[ord("|")] = 4
_KIND[[ord("."), ord(",")]] = 5
_KIND[48:58] = 6
_KIND[10] = 7
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True  # a non-ASCII character counts by its first byte


def _by_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of each text, a row each; null counts as empty."""
    body, offsets = column_bytes(column)
    out = [np.zeros((0, len(STATISTICS)))]
    for a, b in slices(offsets):
        out.append(_slice(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return np.concatenate(out)


def _slice(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = Words(body, offsets, VISIBLE)
    n_words = np.diff(words.first).astype(np.float64)
    some = np.maximum(n_words, 1)
    kind = _KIND[body]
    count = {k: _by_document(kind == k, offsets) for k in range(1, 8)}
    letters = _by_document(_LETTER[body], offsets)
    document = words.document()
    same = (words.code[1:] == words.code[:-1]) & (document[1:] == document[:-1])
    echoes = np.bincount(document[1:][same], minlength=len(n_words))
    # rows and the hashes' upper bits in one key: 44 bits are ample within a text
    key = np.sort((document.astype(np.uint64) << np.uint64(44)) | (words.code >> np.uint64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    document = (key >> np.uint64(44)).astype(np.int64)
    distinct = np.bincount(document[new], minlength=len(n_words))
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(letters / some),
            share(count[1], letters),
            share(count[2], some),
            share(count[3], some),
            share(count[4], some),
            share(count[5], some),
            share(count[6], letters + count[6]),
            share(echoes, some),
            np.log((distinct + 1) / (n_words + 1)) / np.log(n_words + 2),
            share(count[7], some),
        ]
    )


@dataclass
class Discriminant:
    """Class means, whitening factors and log-normalisers; classes are 0 and 1."""

    means: np.ndarray
    factors: list[np.ndarray]
    offsets: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, means: np.ndarray, covariances: np.ndarray, shrinkage: float, floor: float) -> Discriminant:
        """From each class's count, and means and covariances of the statistics."""
        k = means.shape[1]
        pooled = np.einsum("c,cii->i", counts, covariances) / max(counts.sum(), 1)
        factors, offsets = [], []
        for c in range(2):
            own = shrinkage + (1 - shrinkage) * k / (counts[c] + k)  # few rows: more shrinkage
            sigma = (1 - own) * covariances[c] + own * np.diag(pooled) + floor * np.eye(k)
            factor = np.linalg.cholesky(sigma)
            factors.append(np.linalg.inv(factor))
            offsets.append(np.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
        return cls(means, factors, np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        density = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in range(2)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _statistics_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", of: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves the held-out remainder; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == fold, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    shrinkage: float = 0.02,
    floor: float = 1e-4,
) -> Discriminant:
    """Learn from all rows of `docs` that have a label 0 or 1.

    Every labelled row counts, repeated ones as often as they stand, a text of any
    length as a whole; null texts count as empty, rows without id or label are left out,
    other columns don't matter. A class without rows gets the pooled Gaussian, so that
    with no labels, or no rows, at all every score is one half. Statistics are computed
    for labelled rows only, which a bitmap of their ids finds without a shuffle of texts.
    """
    marks = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = _statistics_of(likely(rows, marks, "doc_id"), "doc_id", "text").join(marks, "doc_id")
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATISTICS)]
    covariances = [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c{i}_{j}") for i, j in pairs]
    counts, m, c = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for row in x.groupBy("label").agg(F.count("*").alias("n"), *means, *covariances).collect():
        own = row["label"]
        counts[own] = row["n"]
        m[own] = [row[f"m{i}"] for i in range(k)]
        for i, j in pairs:
            c[own, i, j] = c[own, j, i] = row[f"c{i}_{j}"]
    for own in range(2):
        if not counts[own]:
            m[own], c[own] = m[1 - own], c[1 - own]
    return Discriminant.fit(counts, m, c, shrinkage, floor)


def quality_score(spark: SparkSession, model: Discriminant):
    """Column function from a text to its score; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(statistics(text)))

    return score


def score_quality(docs: DataFrame, model: Discriminant, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each document's whole text.

    Null and empty texts get the score of a text without words; repeated rows are
    scored alike; an empty table gives no rows.
    """
    score = quality_score(docs.sparkSession, model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
