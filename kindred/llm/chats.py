"""Conversations as one text each, with marks around turns and a loss mask, assembled by columns.

For a batch of turns the bytes of all segments (marks, escaped roles, escaped texts) get
their places by cumulative lengths, and are scattered into one buffer that becomes an Arrow
column as it is. No string is made for a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import numbered, written
from .text import column_bytes

#: Control strings of common chat templates.
_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_sep|>", "<|im_end|>")


@dataclass(frozen=True)
class Template:
    """Marks of a conversation: `begin`, for each turn `turn` role `body` text `end`, and `close`.

    controls: further strings that no text may bring in; learned: roles whose texts the
    loss is for; escape: what stands behind the first character of a control string
    that was in a text. A text that holds the escaped form gets one escape more, so what was
    there can be told.
    """

    begin: str = "<s>"
    turn: str = "<|im_start|>"
    body: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    close: str = "</s>"
    controls: tuple[str, ...] = _CONTROLS
    learned: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def __post_init__(self):
        if not self.turn or not self.body or not self.end or len({self.turn, self.body, self.end}) < 3:
            raise ValueError("turn, body and end must be three different strings")
        first = {c[0] for c in self.all}
        if len(self.escape.encode()) != 1 or self.escape in "".join(self.all) or any(not x.isascii() for x in first):
            raise ValueError("escape must be one ASCII character that no control string has, and each of these must begin with an ASCII character")
        if any(x in c[1:] for c in self.all for x in first):
            raise ValueError("the first character of a control string must not stand inside of one")
        own = [x for x in (self.begin, self.turn, self.body, self.end, self.close) if x]
        if any(a.startswith(b) for i, a in enumerate(own) for j, b in enumerate(own) if i != j):
            raise ValueError("no mark may begin with another one")

    @property
    def all(self) -> tuple[str, ...]:
        """Control strings, longest first."""
        own = {*self.controls, self.begin, self.turn, self.body, self.end, self.close} - {""}
        return tuple(sorted(own, key=lambda c: (-len(c), c)))

    def escaped(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of texts with each control string escaped.

        A control string has its first character nowhere else, so matches don't overlap,
        and what is put behind that character changes no other match.
        """
        lead = np.zeros(256, dtype=bool)
        lead[[ord(c[0]) for c in self.all]] = True
        at = np.flatnonzero(lead[body])
        if not len(at):
            return body, offsets
        stop = offsets[np.searchsorted(offsets, at, "right")]
        # behind the escapes that are there already
        rest = at + 1
        more = np.flatnonzero(rest < stop)
        while len(more):
            more = more[body[rest[more]] == ord(self.escape)]
            rest[more] += 1
            more = more[rest[more] < stop[more]]
        hit = np.zeros(len(at), dtype=bool)
        for control in self.all:
            tail = np.frombuffer(control[1:].encode(), np.uint8)
            fits = np.flatnonzero((body[at] == ord(control[0])) & (rest + len(tail) <= stop))
            for i, byte in enumerate(tail):
                fits = fits[body[rest[fits] + i] == byte]
            hit[fits] = True
        put = at[hit] + 1
        return np.insert(body, put, ord(self.escape)), offsets + np.searchsorted(put, offsets, "right")

    def unescape(self, text: bytes) -> bytes:
        e = re.escape(self.escape.encode())
        found = b"|".join(re.escape(c[:1].encode()) + e + b"(?=" + e + b"*" + re.escape(c[1:].encode()) + b")" for c in self.all)
        return re.sub(found, lambda m: m[0][:1], text)


#: Spans of the loss are byte ranges of `formatted`, ends exclusive.
SCHEMA = "conv_id long, piece long, last boolean, n_turns long, formatted string, loss array<struct<begin:long,end:long>>"
_LOSS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS)])


def _scatter(out: np.ndarray, at: np.ndarray, body: np.ndarray, offsets: np.ndarray) -> None:
    """Copy rows of bytes to their places in `out`."""
    out[np.arange(len(body)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = body


def _starts(turns: pa.RecordBatch) -> np.ndarray:
    """Rows at which a conversation begins, or goes on behind a gap."""
    number, pos = turns.column("conv_id"), turns.column("pos").to_numpy()
    null, value = number.is_null().to_numpy(zero_copy_only=False), number.fill_null(0).to_numpy()
    new = np.ones(len(turns), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.flatnonzero(new)


def assemble(turns: pa.RecordBatch, template: Template, most: int) -> pa.RecordBatch:
    """Formatted pieces of sorted turns (conv_id, pos, last, role, text), one for each run of a conversation, cut behind each `most` bytes.

    pos: place of the turn in its conversation; last: whether it ends there.
    """
    n, start = len(turns), _starts(turns)
    pos, last = turns.column("pos").to_numpy(), turns.column("last").to_numpy(zero_copy_only=False)
    roles, texts = (template.escaped(*column_bytes(turns.column(c))) for c in ("role", "text"))
    # bytes of the run up to each turn
    run = np.cumsum(np.isin(np.arange(n), start)) - 1
    size = (roles[1] + texts[1])[:-1]
    part = (size - size[start][run]) // most
    start = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (part[1:] != part[:-1])))
    stop = np.append(start[1:], n)[: len(start)]
    begin, turn, body, end, close = (np.frombuffer(x.encode(), np.uint8) for x in (template.begin, template.turn, template.body, template.end, template.close))
    # of each turn: begin, turn, role, body, text, end, close
    sizes = np.empty((n, 7), dtype=np.int64)
    sizes[:, 0], sizes[:, 6] = np.where(pos == 0, len(begin), 0), np.where(last, len(close), 0)
    sizes[:, 1], sizes[:, 3], sizes[:, 5] = len(turn), len(body), len(end)
    sizes[:, 2], sizes[:, 4] = np.diff(roles[1]), np.diff(texts[1])
    ends = np.cumsum(sizes.ravel()).reshape(n, 7)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, dtype=np.uint8)
    if len(out) >> 31:
        raise ValueError("turns of more than 2 GB at a time: lower spark.sql.execution.arrow.maxBytesPerBatch")
    for column, mark, some in ((0, begin, pos == 0), (1, turn, pos >= 0), (3, body, pos >= 0), (5, end, pos >= 0), (6, close, last)):
        out[begins[some, column][:, None] + np.arange(len(mark))] = mark
    _scatter(out, begins[:, 2], *roles)
    _scatter(out, begins[:, 4], *texts)
    offsets = np.append(begins[start, 0], len(out))
    formatted = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    spans = np.flatnonzero(pa.compute.is_in(turns.column("role"), pa.array(template.learned, pa.string())).to_numpy(zero_copy_only=False))
    base = begins[start, 0][np.searchsorted(start, spans, "right") - 1]
    loss = pa.StructArray.from_arrays([pa.array(begins[spans, 4] - base), pa.array(ends[spans, 4] - base)], names=["begin", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(spans, np.append(start, n)).astype(np.int32)), loss)
    columns = [turns.column("conv_id").take(pa.array(start)), pa.array(pos[start]), pa.array(last[stop - 1]), pa.array(stop - start), formatted, loss]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _format(template: Template, most: int):
    """Pieces of sorted turns; a conversation is cut only where its turns have gaps or more than `most` bytes have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if not len(rows):
                continue
            cut = int(_starts(rows)[-1])  # from here on, the conversation may go on in the next batch
            if rows.slice(cut).nbytes > most:
                cut = len(rows)
            if cut:
                yield assemble(rows.slice(0, cut), template, most)
            rest = rows.slice(cut)
        if rest is not None and len(rest):
            yield assemble(rest, template, most)

    return run


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece_bytes: int = 32 << 20,
) -> DataFrame:
    """(conv_id, piece, last, n_turns, formatted, loss) of each conversation.

    Turns are in order of their numbers, null first, and of one number in order of role and
    text; repeated rows are turns as often as they stand. Null texts and roles count as empty, null ids are
    one conversation. loss: the byte ranges of `formatted` with the texts of the template's
    `learned` roles, each turn one range, in order. An empty table gives no rows; other columns don't matter.

    A conversation with up to `piece_bytes` of texts is one row, with piece 0. A longer one comes in
    several rows, which no task has to hold together: its turns are dealt to tasks by their
    places, and piece is the place of a row's first turn. Rows of a conversation in order of
    piece, one behind the other, are its text; only the first has the template's `begin`, only
    the `last` one its `close`. Texts are never cut: a turn is in one row.
    """
    template = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    size = F.sum(F.octet_length("text") + F.octet_length("role")).cast("long")
    long = written(rows.groupBy("conv_id").agg(size.alias("size")).where(F.col("size") > piece_bytes).select(F.col("conv_id").alias("long_id")))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    order = ("turn", "role", "text")
    own = Window.partitionBy("conv_id").orderBy(*order)
    short = rows if long.isEmpty() else rows.join(long, is_long, "left_anti")
    short = short.select("*", (F.row_number().over(own) - 1).cast("long").alias("pos"), F.lead(F.lit(1)).over(own).isNull().alias("last"))
    columns = ("conv_id", "pos", "last", "role", "text")
    out = short.select(*columns).mapInArrow(_format(template, 2 * piece_bytes), SCHEMA)
    if not long.isEmpty():
        placed = numbered(written(rows.join(long, is_long, "left_semi")), "conv_id", order)
        placed = placed.withColumn("last", F.col("pos") == F.col("n") - 1)
        placed = placed.repartition("conv_id", F.shiftright("pos", 10)).sortWithinPartitions("conv_id", "pos")
        out = out.unionByName(placed.select(*columns).mapInArrow(_format(template, piece_bytes), SCHEMA))
    return out


def parse(text: bytes, template: Template) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn in formatted bytes."""
    begin, turn, body, end, close = (x.encode() for x in (template.begin, template.turn, template.body, template.end, template.close))
    out = []
    for part in text.removeprefix(begin).removesuffix(close).split(turn)[1:]:
        role, own = part.split(body)
        out.append((template.unescape(role), template.unescape(own.removesuffix(end))))
    return out


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, pos, role, text, learned) of each turn in the rows of `format_chats`; learned: whether the loss mask has it."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, piece, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, masked = text.encode(), {s["begin"] for s in loss}
                at = len(template.begin.encode()) if piece == 0 else 0
                for i, part in enumerate(body[at:].split(template.turn.encode())[1:]):
                    head = len(template.turn.encode()) + part.index(template.body.encode()) + len(template.body.encode())
                    ((role, own),) = parse(template.turn.encode() + part, template)
                    rows.append((number, piece + i, role.decode(), own.decode(), at + head in masked))
                    at += len(template.turn.encode()) + len(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TURN_TYPES, strict=True)], names=["conv_id", "pos", "role", "text", "learned"]) if rows else _NO_TURNS

    return formatted.select("conv_id", "piece", "formatted", "loss").mapInArrow(run, "conv_id long, pos long, role string, text string, learned boolean")


_TURN_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
_NO_TURNS = pa.RecordBatch.from_arrays([pa.array([], t) for t in _TURN_TYPES], names=["conv_id", "pos", "role", "text", "learned"])

_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digests:
    """Digests of one conversation, whose pieces come one by one."""

    def __init__(self, number: int | None):
        self.number, self.turns, self.chars, self.formatted = number, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict], template: Template) -> None:
        body = text.encode()
        for role, own in parse(body, template):
            self.turns += 1
            self.all.update(role + b"\n" + own + b"\n")
        for span in loss:
            own = template.unescape(body[span["begin"] : span["end"]])
            self.chars += len(own.decode())
            self.loss.update(own)
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.number, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the rows of `format_chats`, as a written table, read back to: one row of digests for each conversation.

    turns_sha256: of role, line feed, text and line feed of each turn; loss_sha256 and
    loss_chars: of all bytes under the loss mask, unescaped; formatted_chars: code points of
    the formatted text. A conversation in one piece is read where it lies. Pieces of a longer
    one are read in order by one task, since a digest goes from byte to byte, of which it holds one at a time.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            done = []
            for number, piece, last, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    open_ = _Digests(number)
                open_.add(text, loss, template)
                if last:
                    done.append(open_.row())
            if done:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[c.split()[0] for c in _DIGESTS.split(", ")])

    columns = ("conv_id", "piece", "last", "formatted", "loss")
    whole = (F.col("piece") == 0) & F.col("last")
    several = formatted.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return formatted.where(whole).select(*columns).mapInArrow(run, _DIGESTS).unionByName(several.select(*columns).mapInArrow(run, _DIGESTS))
