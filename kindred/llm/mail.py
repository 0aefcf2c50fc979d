"""Packed messages between blocks of rows and ranges of hash values.

Rows are kept in blocks, one group of a Spark job each. What blocks have in common is
found where hash values meet: each block sends its values, sorted and packed into arrays,
to ranges of them, and each range answers. So a message, not a value, is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: `to` is a range or a block, `block` where the message comes from.
MAIL = "to int, kind int, block int, a binary, b binary, c binary, d binary, e binary"
_TYPES = [("to", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in "abcde")]


def mail_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*(r + (b"",) * (8 - len(r)) for r in rows), strict=True)) or [()] * 8
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_TYPES, columns, strict=True)})


def squeeze(x: bytes | memoryview) -> bytes:
    return memoryview(x).nbytes.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(x, asbytes=True)


def unsqueezed(x: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _turned(x: np.ndarray) -> np.ndarray:
    """A matrix of bytes turned, by rows or columns of it: far faster than byte by byte, as one is short."""
    out = np.empty(x.shape[::-1], np.uint8)
    if x.shape[0] < x.shape[1]:
        for k, row in enumerate(x):
            out[:, k] = row
    else:
        for k, row in enumerate(out):
            row[:] = x[:, k]
    return out


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all lowest ones first: those that are all zero compress to nothing."""
    return squeeze(_turned(x.view(np.uint8).reshape(len(x), x.itemsize)).data)


def whole(x: bytes, kind: type) -> np.ndarray:
    return _turned(np.frombuffer(unsqueezed(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)).view(kind).ravel()


def letters(target: np.ndarray, kind: int, block: int, *columns: np.ndarray, rising: bool = False) -> list[tuple]:
    """One message for each target; `rising`: the first column is sorted, its differences are sent."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    sorted_target = target[order]
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(sorted_target)) + 1):
        packed = [c[part] for c in columns]
        if rising:
            packed[0] = np.diff(packed[0], prepend=np.uint64(0))
        out.append((int(target[part[0]]), kind, block, *map(planes, packed)))
    return out


def read(table: pa.Table, kind: int, *types: type, rising: bool = False) -> tuple[np.ndarray, ...]:
    """The columns of all messages of a kind, and the block that each entry comes from."""
    rows = np.flatnonzero(table.column("kind").to_numpy() == kind) if table.num_rows else []
    part = table.take(pa.array(rows, pa.int64())) if len(rows) else None
    out = []
    for name, t in zip("abcde", types, strict=False):
        pieces = [whole(x, t) for x in part.column(name).to_pylist()] if part is not None else []
        if rising and name == "a":
            pieces = [np.cumsum(x, dtype=np.uint64) for x in pieces]
        out.append(np.concatenate(pieces) if pieces else np.zeros(0, t))
        if name == "a":
            block = np.repeat(np.array(part.column("block").to_pylist() if part is not None else [], np.int64), [len(x) for x in pieces])
    return (*out, block)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for `size[i]` places, one run behind the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and size of each run of entries that are equal in all columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, n))
