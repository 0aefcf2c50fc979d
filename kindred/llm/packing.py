"""Best-fit packing of documents into training sequences.

Each task streams its documents once: it tokenizes a text, cuts off what is
longer than a sequence, and places each piece with bounded-space online
best-fit. A fixed number of bins is open. A bitset keyed by free space finds the
open bin that a piece fills best; if there is none a bin is opened, and when too
many are open the fullest closes. No text is shuffled or collected and a task
keeps only its open bins. The pieces in bins that are open when tasks end, a few bins of each, are then packed
anew, those of 64 tasks together, so that many small partitions cost few sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import written

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32())]
    + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]
)
#: Fixed value: how this vocabulary splits a text before its merges apply.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BestFit:
    """Bounded-space online best-fit with a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.mask = 0  # bit f: a bin with f free places is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to `capacity` tokens."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        rest = free - length
        if rest:
            if self.open == self.limit:
                fullest = (self.mask & -self.mask).bit_length() - 1
                if fullest >= rest:
                    return number, self.capacity - free  # this bin is the fullest: it closes
                self._take(fullest)
            self.bins[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
        return number, self.capacity - free

    def still_open(self) -> list[int]:
        """All bins that are open."""
        return [number for numbers in self.bins for number in numbers]

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return number


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its ids as an array, for a byte-level BPE file.

    Ids are those of the file's own library with its default settings, by which the
    contents of added tokens are these tokens. A byte-level vocabulary numbers its
    merges in order, so ranks can be read from it for a faster encoder. It is used if
    both give the same ids for one probe text on loading, and only for texts that
    hold no added token's content.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    try:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {chr(b): b for b in printable}
        names |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ranks = {bytes(names[c] for c in token): i for token, i in model["vocab"].items() if all(c in names for c in token)}
        special = {t.content for t in exact.get_added_tokens_decoder().values()}
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}
        fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        added = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        probe = "The quick, brown\n\n fox's 1234 cafés 你好 \U0001f600ß  ---!! x\t\t y <|end Éç"
        if fast.encode_ordinary(probe) != slow(probe).tolist():
            return slow
    except (KeyError, ValueError):  # not a byte-level vocabulary
        return slow

    def quick(text: str) -> np.ndarray:
        if added is not None and added.search(text):
            return slow(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype="<u4") if text else np.zeros(0, dtype="<u4")
        except BaseException as e:  # the encoder panics on some very long runs of one class
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return quick


def pieces(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but perhaps the first."""
    first = length % limit
    cuts = [(0, first)] if first else []
    return cuts + [(s, limit) for s in range(first, length, limit)]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    open_bins: int = 64,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of `max_tokens`.

    A document is the ids of its whole text and then `end_id`; only documents
    longer than a sequence are cut. Null text counts as empty and packs as one
    token; a null id stays null; repeated rows are packed as often as they
    stand; an empty table gives no rows. Only the two named columns are read.
    A text of any length is tokenized as a whole, by one task, which holds its ids. `tokenizer_path` must be
    readable on every executor. Pieces are written as a table in the shared folder first, as
    what the tasks leave in open bins is packed once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path), BestFit(max_tokens, open_bins)
        high = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for i, (start, length) in enumerate(pieces(len(ids), max_tokens)):
                    number, offset = packer.place(length)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc, i, start, length, crc, high + number, offset))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
        # bins that are still open, as pieces without a document
        rest = [(None, _OPEN, 0, 0, 0, high + number, 0) for number in packer.still_open()]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), _ARROW, strict=True)], schema=_ARROW)

    packed = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA))
    bins = packed.where(F.col("piece") == _OPEN).select("sequence_id")
    pieces_ = packed.where(F.col("piece") >= 0)
    again = pieces_.join(bins, "sequence_id", "left_semi").groupBy(F.shiftright("sequence_id", 36 + _TASKS).alias("tasks"))
    return pieces_.join(bins, "sequence_id", "left_anti").select(*_ARROW.names).unionByName(again.applyInArrow(_repack(max_tokens), SCHEMA))


#: The number of a piece that stands for an open bin; tasks whose open bins are packed together, as a power of 2.
_OPEN, _TASKS = -1, 6


def _repack(max_tokens: int):
    """Pieces of some tasks' open bins in new sequences, the longest first."""

    def run(table: pa.Table) -> pa.Table:
        number, offset, size = (table.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
        order = np.lexsort((offset, number, -size))
        packer = BestFit(max_tokens, len(order))
        base = 1 << 62 | int(number[0]) >> 36 + _TASKS << 40
        place = np.array([packer.place(n) for n in size[order].tolist()], dtype=np.int64)
        moved = table.take(pa.array(order)).select([c for c in _ARROW.names if c not in ("sequence_id", "offset")])
        return moved.append_column("sequence_id", pa.array(base + place[:, 0])).append_column("offset", pa.array(place[:, 1])).select(_ARROW.names)

    return run
