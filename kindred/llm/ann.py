"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors are dealt to buckets by a hash of their id; a bucket is one row with packed
arrays, and buckets exchange packed messages through Spark joins. The graph starts
from exact neighbours inside the cells of a few random partitions. Each round of
NN-descent then joins nodes with the neighbours of their neighbours: a node asks the
buckets of its neighbours, forward and reverse, for their vectors, compares them with
one another, and tells both of a pair that is nearer than what they have.

A query is searched greedily: from its own node on, the best candidates that are not
yet expanded are replaced by their neighbours, until none of the best is left to
expand. Scores of results are then computed on the original vectors in double
precision.

Equal vectors are one node, so that any number of copies costs the graph nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import Step, written
from .text import mix

#: Nodes of a bucket and of a cell; the cells' partitions, at least.
BUCKET, CELL, PARTITIONS = 4096, 512, 3
NEIGHBOURS, JOINED, TOLD = 32, 32, 4
#: Rounds go on until so small a share of all neighbours is new.
SETTLED = 0.002
#: Candidates that a search keeps, at least, and expands at a time; edges of a node that it follows.
POOL, EXPAND, DEGREE = 320, 80, 96
#: Nodes from which on partitions and candidates grow.
SMALL = 16384

_NODES = "bucket int, ids binary, vectors binary, near binary, scores binary, fresh binary"
_MAIL = "bucket int, source int, kind int, a binary, b binary, c binary"


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each id."""
    return ((mix(ids.astype(np.int64).view(np.uint64) + np.uint64(11)) >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def partitions(n_nodes: int) -> int:
    """Partitions into cells that the graph of so many nodes starts from: one more for each doubling."""
    return PARTITIONS + max(0, math.ceil(math.log2(max(1, n_nodes) / SMALL)))


def pool_size(n_nodes: int, pool: int = POOL) -> int:
    """Candidates that a search among so many nodes keeps: they grow with the cube root."""
    return math.ceil(pool * max(1.0, n_nodes / SMALL) ** (1 / 3))


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _letters(target: np.ndarray, source: int, kind: int, *columns: np.ndarray) -> list[tuple]:
    """One message for each bucket in `target`."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    sorted_target = target[order]
    cuts = np.flatnonzero(np.diff(sorted_target)) + 1
    out = []
    for part in np.split(order, cuts):
        packed = [_pack(c[part]) for c in columns]
        out.append((int(target[part[0]]), source, kind, *packed, *[b""] * (3 - len(packed))))
    return out


_MAIL_TYPES = (("bucket", pa.int32()), ("source", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()))


def _table(rows: list[tuple], types=_MAIL_TYPES) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(types, columns, strict=True)})


class _Bucket:
    """The nodes of one bucket, sorted by id."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(n, -1)
        self.near = np.frombuffer(row["near"], np.int64).reshape(n, -1)  # -1 in `fresh`: no neighbour
        self.scores = np.frombuffer(row["scores"], np.float32).reshape(n, -1)
        self.fresh = np.frombuffer(row["fresh"], np.int8).reshape(n, -1)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


_NODE_TYPES = (("bucket", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("near", pa.binary()), ("scores", pa.binary()), ("fresh", pa.binary()))


def _rank(a: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by a, then the keys; and each entry's rank within its a."""
    order = np.lexsort((*keys[::-1], a))
    s = a[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return order, rank


def _edges(node: _Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, fresh) of all edges."""
    there = node.fresh >= 0
    row = np.nonzero(there)[0]
    return row, node.near[there], node.fresh[there]


def _reverse(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                node = _Bucket(r)
                row, other, fresh = _edges(node)
                yield from _table(_letters(_home(other, n_buckets), node.number, 1, other, node.ids[row], fresh)).to_batches()

    return run


def _circle(node: _Bucket, mail: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, member, fresh): whom each node joins, from its edges of both directions, fresh ones first."""
    row, other, fresh = _edges(node)
    got = [m for m in mail if m["kind"] == 1]
    if got:
        mine = np.concatenate([np.frombuffer(m["a"], np.int64) for m in got])
        row = np.concatenate([row, node.rows(mine)])
        other = np.concatenate([other, *(np.frombuffer(m["b"], np.int64) for m in got)])
        fresh = np.concatenate([fresh, *(np.frombuffer(m["c"], np.int8) for m in got)])
    order = np.lexsort((-fresh, other, row))
    row, other, fresh = row[order], other[order], fresh[order]
    once = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])]) if len(row) else np.zeros(0, bool)
    row, other, fresh = row[once], other[once], fresh[once]
    chance = mix(other.view(np.uint64) + mix(node.ids[row].view(np.uint64)))
    order, rank = _rank(row, -fresh, chance)
    taken = order[rank < JOINED]
    return row[taken], other[taken], fresh[taken]


def _request(n_buckets: int):
    def run(nodes: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        for r in nodes.to_pylist():
            node = _Bucket(r)
            _, other, _ = _circle(node, mail.to_pylist())
            wanted = np.unique(other)
            out += _letters(_home(wanted, n_buckets), node.number, 2, wanted)
        return _table(out)

    return run


def _reply(nodes: pa.Table, mail: pa.Table) -> pa.Table:
    out = []
    for r in nodes.to_pylist():
        node = _Bucket(r)
        worst = np.where((node.fresh >= 0).all(axis=1), node.scores.min(axis=1), -np.inf).astype(np.float32)
        for m in mail.to_pylist():
            ids = np.frombuffer(m["a"], np.int64)
            at = node.rows(ids)
            out.append((m["source"], node.number, 3, m["a"], _pack(node.vectors[at].astype(np.float16)), _pack(worst[at])))
    return _table(out)


def _join(n_buckets: int):
    """Compare the members of each node's circle with one another."""

    def run(nodes: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        letters = mail.to_pylist()
        for r in nodes.to_pylist():
            node = _Bucket(r)
            row, other, fresh = _circle(node, letters)
            got = [m for m in letters if m["kind"] == 3]
            if not got:
                continue
            ids = np.concatenate([np.frombuffer(m["a"], np.int64) for m in got])
            width = node.vectors.shape[1]
            vectors = np.concatenate([np.frombuffer(m["b"], np.float16).reshape(-1, width) for m in got])
            worst = np.concatenate([np.frombuffer(m["c"], np.float32) for m in got])
            order = np.argsort(ids)
            ids, vectors, worst = ids[order], vectors[order], worst[order]
            _, rank = _rank(row)
            n = len(node.ids)
            member = np.full((n, JOINED), -1, dtype=np.int64)
            new = np.zeros((n, JOINED), dtype=bool)
            member[row, rank], new[row, rank] = np.searchsorted(ids, other), fresh > 0
            found: list[tuple] = []
            for i in range(0, n, 512):
                m, w = member[i : i + 512], new[i : i + 512]
                v = vectors[m].astype(np.float32)
                product = v @ v.transpose(0, 2, 1)
                good = (m[:, :, None] >= 0) & (m[:, None, :] >= 0) & (m[:, :, None] != m[:, None, :])
                good &= (w[:, :, None] | w[:, None, :]) & (product > worst[m][:, :, None])
                product = np.where(good, product, -np.inf)
                best = np.argpartition(-product, TOLD - 1, axis=2)[:, :, :TOLD]
                score = np.take_along_axis(product, best, 2)
                keep = score > -np.inf
                a = np.broadcast_to(m[:, :, None], score.shape)[keep]
                b = np.take_along_axis(np.broadcast_to(m[:, None, :], product.shape), best, 2)[keep]
                found.append((a, b, score[keep]))
            a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
            pair = np.unique(a * len(ids) + b, return_index=True)[1]
            a, b, s = ids[a[pair]], ids[b[pair]], s[pair].astype(np.float32)
            out += _letters(_home(a, n_buckets), node.number, 4, a, b, s)
        return _table(out)

    return run


def _update(first: bool):
    """New neighbour lists from what a node has and is told."""

    def run(nodes: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        letters = mail.to_pylist()
        for r in nodes.to_pylist():
            node = _Bucket(r)
            n = len(node.ids)
            row, other, fresh = _edges(node)
            score = node.scores[node.fresh >= 0]
            if not first:  # edges that took part in this round are no longer fresh
                joined_row, joined, _ = _circle(node, letters)
                key = np.unique(_pairs(joined_row, joined))
                fresh = np.where(np.isin(_pairs(row, other), key), 0, fresh).astype(np.int8)
            told = [m for m in letters if m["kind"] == 4]
            if told:
                a = node.rows(np.concatenate([np.frombuffer(m["a"], np.int64) for m in told]))
                row = np.concatenate([row, a])
                other = np.concatenate([other, *(np.frombuffer(m["b"], np.int64) for m in told)])
                score = np.concatenate([score, *(np.frombuffer(m["c"], np.float32) for m in told)])
                fresh = np.concatenate([fresh, np.ones(len(a), np.int8)])
            order = np.lexsort((fresh, other, row))  # of equal edges the old one
            row, other, score, fresh = row[order], other[order], score[order], fresh[order]
            once = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])]) if len(row) else np.zeros(0, bool)
            row, other, score, fresh = row[once], other[once], score[once], fresh[once]
            order, rank = _rank(row, -score, other)
            keep = order[rank < NEIGHBOURS]
            rank = rank[rank < NEIGHBOURS]
            near, scores, state = np.full((n, NEIGHBOURS), -1, np.int64), np.full((n, NEIGHBOURS), -np.inf, np.float32), np.full((n, NEIGHBOURS), -1, np.int8)
            near[row[keep], rank], scores[row[keep], rank], state[row[keep], rank] = other[keep], score[keep], fresh[keep]
            out.append((node.number, r["ids"], r["vectors"], _pack(near), _pack(scores), _pack(state)))
        return _table(out, _NODE_TYPES)

    return run


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours that haven't taken part in a round yet."""
    for batch in batches:
        n = [int((np.frombuffer(x, np.int8) > 0).sum()) for x in batch.column("fresh").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])


def _pairs(row: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix(other.view(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1)))


def _cells(seed: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, bits)).astype(np.float32)


def _assign(bits: int, width: int, parts: int):
    """(part, cell) of each vector in each random partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [_cells(p + 1, bits, width) for p in range(parts)]
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
            for p, plane in enumerate(planes):
                cell = ((v @ plane > 0) << np.arange(bits)).sum(axis=1).astype(np.int64) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(v), p, np.int32)), pa.array(cell)], names=["id", "vector", "part", "cell"])

    return run


def _start(n_buckets: int, width: int):
    """Exact neighbours inside the cells of a task."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        cells = table.column("unit").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, width)
        found = []
        order = np.lexsort((ids, cells))
        for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            k = min(NEIGHBOURS, len(part) - 1)
            if k < 1:
                continue
            for i in range(0, len(part), 1024):  # blocks of rows against the cell
                rows = part[i : i + 1024]
                product = vectors[rows] @ vectors[part].T
                product[np.arange(len(rows)), i + np.arange(len(rows))] = -np.inf
                best = np.argpartition(-product, k - 1, axis=1)[:, :k]
                found.append((np.repeat(ids[rows], k), ids[part[best]].ravel(), np.take_along_axis(product, best, 1).ravel()))
        if not found:
            return _table([])
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return _table(_letters(_home(a, n_buckets), -1, 4, a, b, s.astype(np.float32)))

    return run


def _gather(width: int):
    """One row for the nodes of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, width)
        order = np.argsort(ids)
        n = len(ids)
        empty = np.full((n, NEIGHBOURS), -1, np.int64), np.full((n, NEIGHBOURS), -np.inf, np.float32), np.full((n, NEIGHBOURS), -1, np.int8)
        return _table([(table.column("bucket")[0].as_py(), _pack(ids[order]), _pack(vectors[order]), *map(_pack, empty))], _NODE_TYPES)

    return run


def neighbour_graph(vectors: DataFrame, n_nodes: int, width: int, settled: float = SETTLED) -> tuple[Step, int]:
    """Bucket rows with each node's approximate nearest neighbours, and the number of buckets.

    vectors: (id, vector: packed 32-bit floats), of distinct ids.
    """
    n_buckets = max(1, -(-n_nodes // BUCKET))
    parts = partitions(n_nodes)
    bits = max(0, math.ceil(math.log2(max(1, n_nodes) / CELL)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_home(batch.column(0).to_numpy(), n_buckets).astype(np.int32)), batch.column(0), batch.column(1)], names=["bucket", "id", "vector"])

    nodes = vectors.mapInArrow(home, "bucket int, id long, vector binary").groupBy("bucket").applyInArrow(_gather(width), _NODES)
    nodes = written(nodes)
    placed = vectors.mapInArrow(_assign(bits, width, parts), "id long, vector binary, part int, cell long")
    # a cell with too many vectors, as near copies make, is dealt out further
    sizes = written(placed.groupBy("part", "cell").agg(F.count("*").alias("n")))
    unit = F.xxhash64("part", "cell", F.pmod(F.xxhash64("id", "part"), F.ceil(F.col("n") / (2 * CELL))))
    tasks = max(1, -(-n_nodes * parts // (8 * CELL)))
    placed = placed.join(sizes, ["part", "cell"]).select("id", "vector", unit.alias("unit")).withColumn("task", F.pmod("unit", F.lit(tasks)))
    told = placed.groupBy("task").applyInArrow(_start(n_buckets, width), _MAIL)
    step = Step(nodes.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_update(True), _NODES))
    new = n_nodes * NEIGHBOURS
    while new > settled * n_nodes * NEIGHBOURS:
        nodes = step.df
        by = lambda mail: nodes.groupBy("bucket").cogroup(mail.groupBy("bucket"))  # noqa: B023, E731
        reverse = nodes.mapInArrow(_reverse(n_buckets), _MAIL)
        asked = by(reverse).applyInArrow(_request(n_buckets), _MAIL)
        replies = by(asked).applyInArrow(_reply, _MAIL)
        told = by(reverse.unionByName(replies)).applyInArrow(_join(n_buckets), _MAIL)
        step.set(by(reverse.unionByName(told)).applyInArrow(_update(False), _NODES))
        new = step.df.mapInArrow(_fresh, "n long").agg(F.sum("n")).first()[0]
    return step, n_buckets


_ADJACENT = "bucket int, ids binary, vectors binary, offsets binary, near binary"
_ADJACENT_TYPES = (("bucket", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("offsets", pa.binary()), ("near", pa.binary()))


def _both_ways(nodes: pa.Table, mail: pa.Table) -> pa.Table:
    """Edges of both directions, the DEGREE with the smallest hash of the reverse ones at most."""
    out = []
    for r in nodes.to_pylist():
        node = _Bucket(r)
        row, other, _ = _edges(node)
        own = np.zeros(len(row), np.int8)
        got = mail.to_pylist()
        if got:
            row = np.concatenate([row, node.rows(np.concatenate([np.frombuffer(m["a"], np.int64) for m in got]))])
            other = np.concatenate([other, *(np.frombuffer(m["b"], np.int64) for m in got)])
            own = np.concatenate([own, np.ones(len(row) - len(own), np.int8)])
        order = np.lexsort((own, other, row))
        row, other, own = row[order], other[order], own[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])]) if len(row) else np.zeros(0, bool)
        row, other, own = row[once], other[once], own[once]
        order, rank = _rank(row, own, _pairs(row, other))
        keep = np.sort(order[rank < DEGREE])
        row, other = row[keep], other[keep]
        out.append((node.number, r["ids"], r["vectors"], _pack(np.searchsorted(row, np.arange(len(node.ids) + 1)).astype(np.int64)), _pack(other)))
    return _table(out, _ADJACENT_TYPES)


class _Graph:
    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(self.ids), -1)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.near = np.frombuffer(row["near"], np.int64)


# Messages of the search. From queries to nodes: a = query ids, b = numbers of nodes for each, c = nodes;
# with kind 6, vectors of the queries follow the ids in a. Back, likewise, with neighbours or scores.
_POOLS = "bucket int, queries binary, vectors binary, pool binary, scores binary, open binary"
_POOL_TYPES = (("bucket", pa.int32()), ("queries", pa.binary()), ("vectors", pa.binary()), ("pool", pa.binary()), ("scores", pa.binary()), ("open", pa.binary()))


class _Pools:
    """Candidates of the queries of one task, best first; open: not yet expanded."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.queries = np.frombuffer(row["queries"], np.int64)
        n = len(self.queries)
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(n, -1)
        self.pool = np.frombuffer(row["pool"], np.int64).reshape(n, -1)
        self.scores = np.frombuffer(row["scores"], np.float32).reshape(n, -1)
        self.open = np.frombuffer(row["open"], np.int8).reshape(n, -1)  # -1: no candidate

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of what is expanded now."""
        row, column = np.nonzero(self.open == 1)
        order, rank = _rank(row, column)
        taken = order[rank < EXPAND]
        return row[taken], self.pool[row[taken], column[taken]]


def _by_query(target: np.ndarray, source: int, kind: int, row: np.ndarray, nodes: np.ndarray, queries: np.ndarray, vectors: np.ndarray | None) -> list[tuple]:
    """A message for each bucket: queries with counts, nodes grouped by query, and the queries' vectors."""
    out = []
    order = np.lexsort((row, target))
    for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(order) else []:
        rows, counts = np.unique(row[part], return_counts=True)
        head = np.column_stack([queries[rows], counts]).astype(np.int64)
        body = _pack(vectors[rows]) if vectors is not None else b""
        out.append((int(target[part[0]]), source, kind, _pack(head), _pack(nodes[part]), body))
    return out


def _expand(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pools = _Pools(r)
                row, node = pools.next()
                yield from _table(_by_query(_home(node, n_buckets), pools.number, 5, row, node, pools.queries, None)).to_batches()

    return run


def _neighbours(graph: pa.Table, mail: pa.Table) -> pa.Table:
    """The distinct neighbours of the nodes that each query expands."""
    out = []
    for r in graph.to_pylist():
        g = _Graph(r)
        for m in mail.to_pylist():
            head = np.frombuffer(m["a"], np.int64).reshape(-1, 2)
            at = np.searchsorted(g.ids, np.frombuffer(m["b"], np.int64))
            degree = g.offsets[at + 1] - g.offsets[at]
            row = np.repeat(np.repeat(np.arange(len(head)), head[:, 1]), degree)
            place = np.arange(int(degree.sum())) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(g.offsets[at], degree)
            row, node = _distinct(row, g.near[place])
            counts = np.bincount(row, minlength=len(head))
            out.append((m["source"], g.number, 5, _pack(np.column_stack([head[:, 0], counts]).astype(np.int64)), _pack(node), b""))
    return _table(out)


def _distinct(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((node, row))
    row, node = row[order], node[order]
    if not len(row):
        return row, node
    once = np.concatenate([[True], (row[1:] != row[:-1]) | (node[1:] != node[:-1])])
    return row[once], node[once]


def _received(pools: _Pools, letters: list[dict]) -> tuple[np.ndarray, list[dict]]:
    """Row of each entry of the letters' b."""
    rows = []
    for m in letters:
        head = np.frombuffer(m["a"], np.int64).reshape(-1, 2)
        rows.append(np.repeat(np.searchsorted(pools.queries, head[:, 0]), head[:, 1]))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), letters


def _ask_scores(n_buckets: int):
    """Ask for the scores of neighbours that are not among the candidates."""

    def run(queries: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        for r in queries.to_pylist():
            pools = _Pools(r)
            row, letters = _received(pools, mail.to_pylist())
            if not len(row):
                continue
            node = np.concatenate([np.frombuffer(m["b"], np.int64) for m in letters])
            row, node = _distinct(row, node)
            have = pools.open >= 0
            known = np.isin(_pairs(row, node), _pairs(np.nonzero(have)[0], pools.pool[have]))
            fresh = ~known & (node != pools.queries[row])
            row, node = row[fresh], node[fresh]
            out += _by_query(_home(node, n_buckets), pools.number, 6, row, node, pools.queries, pools.vectors)
        return _table(out)

    return run


def _scores(graph: pa.Table, mail: pa.Table) -> pa.Table:
    out = []
    for r in graph.to_pylist():
        g = _Graph(r)
        for m in mail.to_pylist():
            head = np.frombuffer(m["a"], np.int64).reshape(-1, 2)
            vectors = np.frombuffer(m["c"], np.float32).reshape(len(head), -1)
            at = np.searchsorted(g.ids, np.frombuffer(m["b"], np.int64))
            score = np.empty(len(at), np.float32)
            ends = np.cumsum(head[:, 1])
            for i, (a, b) in enumerate(zip(ends - head[:, 1], ends, strict=True)):
                score[a:b] = g.vectors[at[a:b]] @ vectors[i]
            out.append((m["source"], g.number, 7, m["a"], m["b"], _pack(score)))
    return _table(out)


def _take(size: int):
    """Candidates after a round: what was expanded is closed, what is near enough comes in."""

    def run(queries: pa.Table, mail: pa.Table) -> pa.Table:
        out = []
        for r in queries.to_pylist():
            pools = _Pools(r)
            n = len(pools.queries)
            opened = pools.open.copy()
            place, column = np.nonzero(pools.open == 1)
            order, rank = _rank(place, column)
            done = order[rank < EXPAND]
            opened[place[done], column[done]] = 0
            have = opened >= 0
            row, node, score, state = np.nonzero(have)[0], pools.pool[have], pools.scores[have], opened[have]
            more, letters = _received(pools, mail.to_pylist())
            if len(more):
                row = np.concatenate([row, more])
                node = np.concatenate([node, *(np.frombuffer(m["b"], np.int64) for m in letters)])
                score = np.concatenate([score, *(np.frombuffer(m["c"], np.float32) for m in letters)])
                state = np.concatenate([state, np.ones(len(more), np.int8)])
            order, rank = _rank(row, -score, node)
            keep, rank = order[rank < size], rank[rank < size]
            pool, scores, opened = np.full((n, size), -1, np.int64), np.full((n, size), -np.inf, np.float32), np.full((n, size), -1, np.int8)
            pool[row[keep], rank], scores[row[keep], rank], opened[row[keep], rank] = node[keep], score[keep], state[keep]
            out.append((pools.number, r["queries"], r["vectors"], _pack(pool), _pack(scores), _pack(opened)))
        return _table(out, _POOL_TYPES)

    return run


def _open_pools(width: int, size: int):
    """Searches that begin at the query's own node."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, width)
        order = np.argsort(ids)
        n = len(ids)
        pool, scores, opened = np.full((n, size), -1, np.int64), np.full((n, size), -np.inf, np.float32), np.full((n, size), -1, np.int8)
        pool[:, 0], scores[:, 0], opened[:, 0] = ids[order], np.inf, 1
        return _table([(table.column("bucket")[0].as_py(), _pack(ids[order]), _pack(vectors[order]), _pack(pool), _pack(scores), _pack(opened))], _POOL_TYPES)

    return run


def _results(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pools = _Pools(r)
                row, column = np.nonzero(pools.open[:, :k] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(pools.queries[row]), pa.array(pools.pool[row, column])], names=["query_node", "node"])

    return run


def search(graph: DataFrame, n_buckets: int, queries: DataFrame, width: int, n_queries: int, k: int, size: int = POOL) -> DataFrame:
    """(query_node, node): the k nearest nodes that a greedy search finds for each query, itself included."""
    adjacent = written(graph.groupBy("bucket").cogroup(graph.mapInArrow(_reverse(n_buckets), _MAIL).groupBy("bucket")).applyInArrow(_both_ways, _ADJACENT))
    tasks = max(1, -(-n_queries // 256))
    step = Step(queries.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")).groupBy("bucket").applyInArrow(_open_pools(width, size), _POOLS))
    searching = True
    while searching:  # ends, as nothing that has left the candidates comes back
        pools = step.df
        asked = pools.mapInArrow(_expand(n_buckets), _MAIL)
        near = adjacent.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_neighbours, _MAIL)
        wanted = pools.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInArrow(_ask_scores(n_buckets), _MAIL)
        scored = adjacent.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_scores, _MAIL)
        step.set(pools.groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(_take(size), _POOLS))
        searching = not step.df.where(F.expr("locate(x'01', open) > 0")).isEmpty()
    found = written(step.df.mapInArrow(_results(k), "query_node long, node long"))
    step.drop()
    return found


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, settled: float = SETTLED, pool: int = POOL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others of each vector whose id is divisible by `every`.

    settled: rounds of NN-descent go on until at most so great a share of all
    neighbours is new. pool: candidates that a search among up to SMALL nodes keeps;
    among more they grow with the cube root of the nodes. A search goes on until each of
    its candidates is expanded. What bounds the work of a node in a round are JOINED
    neighbours that it compares, of both directions and drawn anew in each round, the
    TOLD nearest of which each is told, and NEIGHBOURS that it keeps; of its edges a
    search follows DEGREE. These make the answers approximate; recall is measured.

    Nearness is the largest inner product in double precision, ties to the smaller
    id. Rows with a null id, and vectors that are null, zero, or hold a null or
    non-finite component take no part; nor do vectors of another length than most
    (the longer one, if equally many). Of rows that share an id one counts. With
    fewer than k others, all that the search reaches are returned; an empty table
    gives no rows, and other columns don't matter. Equal vectors are one node, so copies
    are found for certain; of many copies the k + 1 with the smallest ids are used.
    Inside the graph vectors have 32 bits, and 16 on their way, scaled so that the
    largest component of all is 1.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["n"]
    rows = rows.where(F.size("v") == width).select("id", "v", F.xxhash64("v").alias("h"))
    rows = written(rows.groupBy("id").agg(F.min_by("v", "h").alias("v"), F.min("h").alias("h")).select("id", "v", F.xxhash64("v", F.lit(3)).alias("h2"), "h"))
    # equal vectors are one node, known by their smallest id
    order = Window.partitionBy("h", "h2").orderBy("id")
    first = rows.select("id", "h", "h2", F.row_number().over(order).alias("nth")).where(F.col("nth") <= k + 1)
    node = written(rows.groupBy("h", "h2").agg(F.min("id").alias("node")))
    members = first.join(node, ["h", "h2"]).select("node", F.col("id").alias("vec_id"))
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    packed = written(_packed(rows.join(node.select(F.col("node").alias("id")), "id", "left_semi").select("id", "v"), largest))
    n_nodes = packed.count()
    asking = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "h", "h2").join(node, ["h", "h2"]).select(F.col("id").alias("query_id"), "node")
    asking = written(asking)
    sought = written(asking.select(F.col("node").alias("id")).distinct())
    graph, n_buckets = neighbour_graph(packed, n_nodes, width, settled)
    found = search(graph.df, n_buckets, packed.join(sought, "id", "left_semi"), width, max(1, sought.count()), 2 * k, pool_size(n_nodes, pool))
    graph.drop()
    # exact scores of the nodes found, once for equal queries
    one = rows.select(F.col("id").alias("query_node"), F.col("v").alias("q"))
    other = rows.select(F.col("id").alias("node"), F.col("v").alias("x"))
    dot = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(one, "query_node").join(other, "node").select("query_node", "node", dot.alias("score"))
    pairs = scored.join(members, "node").select("query_node", "vec_id", "score")
    best = Window.partitionBy("query_node").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.select("*", F.row_number().over(best).alias("r")).where(F.col("r") <= k + 1)
    answers = asking.join(pairs, asking["node"] == pairs["query_node"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _packed(rows: DataFrame, largest: float) -> DataFrame:
    """Vectors as bytes of 32-bit floats, of which the largest of all is 1: inner products keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            n = len(column)
            values = (column.flatten().to_numpy() / largest).astype(np.float32).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in values], pa.binary())], names=["id", "vector"])

    return rows.mapInArrow(run, "id long, vector binary")
