"""N-gram Jaccard join: MinHash banding, then exact verification on whole n-gram sets.

Texts with the same set of word n-grams are one class and meet by a 128-bit hash
of the set. Classes that share a band of their MinHash signature are candidates;
only links to each band's smallest class are made, whose components are the
clusters in which all similar pairs lie that any band shows. Within a cluster every
pair is compared on the full sets: clusters are cut into blocks, tasks take pairs
of blocks, and intersections are counted with small matrix products, so that a
group of n near copies costs n * n cheap steps but never n * n rows. A task
returns how many links each text has, and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import written, components, key_id, likely, row_key, split
from .text import Words, column_bytes, mix, slices

#: A chance of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996 for a pair of similarity 0.8.
BANDS, ROWS = 20, 5
#: Texts and bytes of sets in a block of a large cluster, and bytes of small clusters in a task.
BLOCK, BLOCK_BYTES, TASK_BYTES = 512, 4 << 20, 8 << 20
_DOC = "doc struct<n: boolean, id: bigint, t: bigint>"
_DOCUMENTS = 4096


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    return (x[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[1::2] >> np.uint64(32)).astype(np.uint32)


def sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, sorted distinct n-grams, each row's first) of a text column.

    An n-gram is known by 52 bits of its hash. A text of fewer words, but not
    none, is one n-gram.
    """
    body, offsets = column_bytes(column)
    for a, b in slices(offsets):
        for c in range(a, b, _DOCUMENTS):
            d = min(b, c + _DOCUMENTS)
            words = Words(body[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
            code, first = words.windows(n)
            row = np.repeat(np.arange(d - c, dtype=np.uint64), np.diff(first))
            key = np.sort((row << np.uint64(52)) | (code >> np.uint64(12)))
            if len(key):
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            starts = np.searchsorted(key, np.arange(d - c + 1, dtype=np.uint64) << np.uint64(52))
            yield c, d, key & np.uint64((1 << 52) - 1), starts


def _signatures(n: int):
    a, b = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, d, code, starts in sets(batch.column(1), n):
                size = np.diff(starts)
                there = np.flatnonzero(size)
                at = starts[:-1][there]
                k = len(there)
                mins = np.zeros((BANDS * ROWS, k), dtype=np.uint64)
                s1 = s2 = np.zeros(k, dtype=np.uint64)
                if k:
                    small = (mix(code) >> np.uint64(32)).astype(np.uint32)
                    for i in range(BANDS * ROWS):
                        mins[i] = np.minimum.reduceat(small * a[i] + b[i], at)
                    s1 = mix(np.add.reduceat(mix(code + np.uint64(1)), at) + size[there].astype(np.uint64))
                    s2 = mix(np.add.reduceat(mix(code ^ np.uint64(0x5DEECE66D)), at))
                bands = np.zeros((BANDS, k), dtype=np.uint64)
                for i in range(BANDS * ROWS):
                    bands[i // ROWS] = mix(bands[i // ROWS] + mins[i] + np.uint64(i + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c, d - c).take(pa.array(there)),
                        pa.array(s1.view(np.int64)),
                        pa.array(s2.view(np.int64)),
                        pa.array(size[there].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, k * BANDS + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(bands.T).view(np.int64).ravel())),
                    ],
                    names=["doc", "s1", "s2", "size", "bands"],
                )

    return run


def _intersections(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(members)
    code = np.concatenate(members)
    who = np.repeat(np.arange(n), [len(m) for m in members])
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    often = np.diff(np.append(new, len(code)))
    out = np.zeros((n, n), dtype=np.float32)
    # n-grams of many sets: products of a dense matrix, some columns at a time
    dense = np.flatnonzero(often >= max(2, n // 32))
    for i in range(0, len(dense), 1024):
        part = dense[i : i + 1024]
        column = np.repeat(np.arange(len(part)), often[part])
        entry = np.arange(len(column)) - np.repeat(np.cumsum(often[part]) - often[part], often[part]) + np.repeat(new[part], often[part])
        matrix = np.zeros((n, len(part)), dtype=np.float32)
        matrix[who[entry], column] = 1
        out += matrix @ matrix.T
    # of few: their pairs
    for k in np.unique(often[(often >= 2) & (often < max(2, n // 32))]):
        rows = who[new[often == k][:, None] + np.arange(k)]
        for i in range(0, len(rows), max(1, (1 << 20) // int(k * k))):
            part = rows[i : i + max(1, (1 << 20) // int(k * k))]
            pair = (part[:, :, None] * n + part[:, None, :]).ravel()
            out += np.bincount(pair, minlength=n * n).reshape(n, n) if len(pair) * 4 > n * n else _scatter(pair, n)
    return out


def _scatter(pair: np.ndarray, n: int) -> np.ndarray:
    at, times = np.unique(pair, return_counts=True)
    out = np.zeros(n * n, dtype=np.float32)
    out[at] = times
    return out.reshape(n, n)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member that each one reaches over the links."""
    root = np.arange(len(linked))
    row, other = np.nonzero(linked)
    while len(row):
        least = root.copy()
        np.minimum.at(least, row, root[other])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def similar(members: list[np.ndarray], threshold: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set and its root among them. `first`: only pairs of a set before it and one behind."""
    size = np.array([len(m) for m in members], dtype=np.float64)
    both = _intersections(members)
    linked = np.empty(both.shape, dtype=bool)
    for i in range(0, len(size), 256):  # some rows at a time, in double precision
        linked[i : i + 256] = both[i : i + 256].astype(np.float64) * (1 + threshold) >= threshold * (size[i : i + 256, None] + size[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if first is not None:
        linked[:first, :first] = linked[first:, first:] = False
    return linked.sum(axis=1), _roots(linked)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["unit", "side", "s1"]).to_pandas()
        blobs = table.column("grams").to_pylist()
        out: list[tuple[int, int, int]] = []
        for _, rows in frame.groupby("unit", sort=False):
            rows = rows.sort_values(["side", "s1"])
            members = [np.frombuffer(blobs[i], dtype=np.uint64) for i in rows.index]
            left = int((rows.side == 0).sum())
            links, root = similar(members, threshold, left if left < len(rows) else None)
            names = rows.s1.to_numpy()
            out += [(names[i], names[root[i]], int(n)) for i, n in enumerate(links) if n]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"node": pa.array(columns[0], pa.int64()), "peer": pa.array(columns[1], pa.int64()), "links": pa.array(columns[2], pa.int64())})

    return run


def _classes(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc, root, n_copies, n_links) of each row with words, root: the first row of its class; rows: (doc, text)."""
    signed = written(rows.mapInArrow(_signatures(n), f"{_DOC}, s1 long, s2 long, size long, bands array<long>"))
    classes = written(signed.groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("n_copies"), F.max("size").alias("size")))
    # in graphs a class goes by the first half of its hash
    one = signed.join(classes.select("s1", F.col("rep").alias("doc")), ["s1", "doc"], "left_semi").dropDuplicates(["s1"]).select("s1", F.explode("bands").alias("band"))
    bands = written(one.groupBy("band").agg(F.min("s1").alias("a"), F.max("s1").alias("z")).where("a <> z").select("band", "a"))
    edges = one.join(bands, "band").where("s1 <> a").select("a", F.col("s1").alias("b"))
    clusters = components(edges)
    links = written(_verified(rows, classes, clusters, n, threshold))
    degree = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    reps = joined.join(classes, joined["id"] == classes["s1"]).groupBy("root").agg(F.min("rep").alias("first"))
    linked = joined.join(reps, "root").join(degree, F.col("id") == F.col("node")).select(F.col("id").alias("s1"), "first", "n_links")
    several = classes.join(linked, "s1", "left").where("n_copies > 1 or first is not null")
    several = written(several.select("s1", "s2", F.coalesce("first", "rep").alias("root"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return signed.select("doc", "s1", "s2").join(several, ["s1", "s2"], "left").select(
        "doc", F.coalesce("root", "doc").alias("root"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def similarity_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of each row.

    Two texts are linked if their sets of word n-grams have a Jaccard similarity of
    at least `threshold`; a class holds all rows that links connect, and class_id is
    the smallest doc_id of them, null if they have none. n_copies counts the rows with
    this very set, n_links the different sets linked to it. Words are runs of ASCII
    letters and digits and other than ASCII characters, without case of A-Z. A text of
    fewer than n words is one n-gram. A text without words (null, empty) is a class of
    its own, of one row and no link. Rows stand for themselves, whether their id is
    null, repeated or neither; repeated rows count as copies. An empty table gives no
    rows, other columns don't matter, and a text of any length counts as a whole.
    """
    rows = docs.select(row_key(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = _classes(rows, n, threshold).select(key_id("doc").alias("doc_id"), key_id("root").alias("class_id"), "n_copies", "n_links")
    empty = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).where(~F.coalesce(F.col("t").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False)))
    return found.union(empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` with one row of each class of similar texts: the first by id, nulls last.

    Classes as for `similarity_classes`. Of classes with rows of one id, or of none, a
    hash of the text decides; of rows that are equal in id and text any one stays. Texts
    without words all stay. Rows of which no other is alike aren't shuffled.
    """
    keyed = docs.withColumn("__doc", row_key(id_col, text_col))
    classes = _classes(keyed.select(F.col("__doc").alias("doc"), F.col(text_col).cast("string").alias("text")), n, threshold)
    alike = written(classes.where("n_copies > 1 or n_links > 0").select(F.col("doc").alias("__doc"), (F.col("doc") == F.col("root")).alias("__stays")).distinct())
    some, others = split(keyed, alike, "__doc")
    some = some.join(alike, "__doc", "left").where(F.coalesce("__stays", F.lit(True)))
    first = some.where(F.col("__stays").isNotNull()).dropDuplicates(["__doc"])
    return first.select(*docs.columns).unionByName(some.where("__stays is null").select(*docs.columns)).unionByName(others.select(*docs.columns))


def _verified(named: DataFrame, classes: DataFrame, clusters: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, peer, links): links of a class in one unit of its cluster, and its root there."""
    known = clusters.join(classes.select(F.col("s1").alias("id"), "rep", "size").dropDuplicates(["id"]), "id")
    sizes = known.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = known.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    placed = written(placed.select("id", "root", "rep", "size", "blocks", "block"))
    reps = written(placed.select(F.col("rep").alias("doc")).distinct())
    wanted = likely(named, reps, "doc").join(reps, "doc").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, d, code, starts in sets(batch.column(1), n):
                size = np.diff(starts)
                there = np.flatnonzero(size)
                at = starts[:-1][there]
                s1 = mix(np.add.reduceat(mix(code + np.uint64(1)), at) + size[there].astype(np.uint64)) if len(there) else np.zeros(0, np.uint64)
                grams = [code[starts[i] : starts[i + 1]].tobytes() for i in there]
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array(grams, pa.binary())], names=["s1", "grams"])

    grams = wanted.mapInArrow(run, "s1 long, grams binary").dropDuplicates(["s1"])
    member = grams.join(placed, grams["s1"] == placed["id"])
    # a unit is a pair of blocks of a cluster; each text goes to the units of its block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.select("s1", "grams", "root", "blocks", "block", other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    member = member.select("s1", "grams", "blocks", F.xxhash64("root", low, high).alias("unit"), F.when(F.col("block") == low, 0).otherwise(1).alias("side"))
    # small clusters share tasks, a unit of a large one has its own
    work = placed.where("blocks = 1").agg(F.coalesce(F.sum("size"), F.lit(0)) * 8).first()[0]
    tasks = max(8, work // TASK_BYTES, 4 * int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.when(F.col("blocks") > 1, F.col("unit")).otherwise(F.pmod("unit", F.lit(tasks)))
    return member.withColumn("task", task).groupBy("task").applyInArrow(_compare(threshold), "node long, peer long, links long")
