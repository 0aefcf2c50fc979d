"""Language identification: multinomial naive Bayes over hashed character n-grams.

A slice of texts becomes one array of letters and spaces, whose n-grams are hashed
into a fixed number of buckets. The matrix of log-probabilities, buckets by
languages, is broadcast (its size is fixed by `buckets` and the languages), and a
text's score is the sum of the rows of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in one numpy pass.
_CHARACTERS = 1 << 20
MAX_LANGUAGES = 4096
NO_LANGUAGE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)], dtype=bool)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHARACTERS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of all n-grams with a letter, and their texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[point]
    symbol = np.where(letter, point, 32).astype(np.uint32)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(point))  # characters to the end of the text
    row = np.repeat(np.arange(len(texts)), sizes)
    for n in orders:
        m = len(point) - n + 1
        if m <= 0:
            continue
        code = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
        some = np.zeros(m, dtype=bool)
        for j in range(n):
            code ^= symbol[j : j + m]
            code *= np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(15)
            some |= letter[j : j + m]
        code *= np.uint32(0xC2B2AE35)
        good = np.flatnonzero(some & (left[:m] >= n))
        yield (code[good] >> np.uint32(32 - bits)).astype(np.int32), row[good]


@dataclass
class NaiveBayes:
    languages: list[str]
    weights: np.ndarray  # language by bucket: log-probabilities
    priors: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; `und` and 0 for a text without a letter."""
        lower = [(t or "").lower() for t in texts]
        totals = np.zeros((len(self.languages), len(texts)))
        counts = np.zeros(len(texts), dtype=np.int64)
        for a, b in _groups(lower):
            for bucket, row in grams(lower[a:b], self.orders, self.bits):
                counts[a:b] += np.bincount(row, minlength=b - a)
                for i, w in enumerate(self.weights):
                    totals[i, a:b] += np.bincount(row, weights=w[bucket], minlength=b - a)
        if not self.languages:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        totals += self.priors[:, None]
        best = totals.argmax(axis=0)
        score = 1 / np.exp(totals - totals.max(axis=0)).sum(axis=0)
        return [self.languages[i] if n else NO_LANGUAGE for i, n in zip(best, counts, strict=True)], np.where(counts > 0, score, 0.0)


def fit_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 20_000,
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    alpha: float = 0.5,
) -> NaiveBayes:
    """Learn from the rows of `docs` with a language.

    `sample` is the bound of this training: of a language with more rows, so many
    are taken in expectation, by a hash of the id and so evenly over the table.
    Priors come from the counts of all rows. Null languages are left out, null texts
    count as empty, other columns don't matter. More than MAX_LANGUAGES languages
    are an error, as their matrix would be too large for the driver; each takes half a
    megabyte with 16 bits. No rows, or none with a language, give a model that knows none.
    """
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return NaiveBayes([], np.zeros((0, 1 << bits)), np.zeros(0), orders, bits)
    scale = 1 << 30
    shares = F.create_map(*(F.lit(x) for k in languages for x in (k, min(scale, int(scale * sample / sizes[k])))))
    taken = named.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scale)) < shares[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for name in set(names):
                own = [(texts[i] or "").lower() for i in np.flatnonzero(names == name)]
                sums = total.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                for a, b in _groups(own):
                    for bucket, _ in grams(own[a:b], orders, bits):
                        sums += np.bincount(bucket, minlength=1 << bits)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), 1 << bits))
    place = {k: i for i, k in enumerate(languages)}
    found = taken.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    who = np.array([place[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
    counts[who, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    used = max(1, int((counts.sum(axis=0) > 0).sum()))
    weights = np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * used)
    rows = np.array([sizes[k] for k in languages], dtype=float)
    return NaiveBayes(languages, weights, np.log(rows / rows.sum()), orders, bits)


def predict_languages(docs: DataFrame, model: NaiveBayes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text, a row for each row.

    Null texts and texts without a letter are `und` with score 0, and so is every
    text if no language was learned. Equal scores go to the first language by name.
    The score is the posterior probability, which n-grams taken as independent make
    nearly 1 for all but short texts; it orders answers, and isn't calibrated. A text of
    any length is used as a whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
