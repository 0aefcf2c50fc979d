"""Language-model scoring with a probabilistic suffix tree over words.

A text is its tokens and one end. The tree predicts a token from the longest kept
suffix of the tokens before it in its text, of the lengths in `contexts` or none: the
query takes three, two and one. A context is
kept if training texts have it at least twice and its next tokens differ from what its
suffix predicts, by a likelihood-ratio test. Its distribution is smoothed: what it
lacks falls to its suffix, in proportion to the kinds of tokens seen behind it (Witten
and Bell). Below no context at all stand the token counts, and below these the
spelling: a small suffix tree over the bytes of distinct words, which gives every word a
probability, seen or not. So all probabilities add up to one.

What is gathered grows with the corpus, and nothing of it is broadcast but the spelling.
Documents are turned once into blocks of token numbers. Blocks ask for what they
need by ranges of hash values, one level after another: counts of tokens; counts of
pairs, which are spread by the pair's hash, so that a frequent word's followers don't
meet in one place (only sums over them do); and counts behind two words, then three, for
places all of whose pairs training texts have twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mail import MAIL, groups, letters, mail_table, planes, read, runs, whole
from .quality import held_out
from .spark import Step, release, written
from .text import VISIBLE, Words, column_bytes, hash_range, mix, slices

END = 10
_LANE = 512
#: Contexts whose distributions are computed at a time.
_CONTEXTS = 8192
#: Known to the model as the token at the end of a text, and its share among unseen tokens.
_STOP, _STOP_SHARE = np.uint64(0x5D1F3A7C9B2E4680), 0.01


def padded(text: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with `depth` END symbols before each, and where each begins."""
    n = len(offsets) - 1
    out = np.full(len(text) + n * depth, END, dtype=np.uint8)
    begin = offsets[:-1] + depth * np.arange(1, n + 1)
    size = np.diff(offsets)
    out[np.arange(len(text)) + np.repeat(depth * np.arange(1, n + 1), size)] = text
    return out, begin


def gram_counts(text: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of depth + 1 symbols, packed into integers, with counts; the last is the next symbol."""
    run, begin = padded(text, offsets, depth)
    code = np.zeros(len(run), dtype=np.uint64)
    for j in range(depth + 1):
        code[depth:] |= run[depth - j : len(run) - j].astype(np.uint64) << np.uint64(8 * j)
    keep = np.zeros(len(run), dtype=bool)
    keep[np.arange(len(text)) + np.repeat(begin - offsets[:-1], np.diff(offsets))] = True
    return packed_counts(np.sort(code[keep]), None)


def packed_counts(sorted_codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_codes):
        return sorted_codes, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    if counts is None:
        return sorted_codes[new], np.diff(np.append(new, len(sorted_codes)))
    return sorted_codes[new], np.add.reduceat(counts, new)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    return packed_counts(codes[order], np.concatenate([n for _, n in parts])[order])


@dataclass
class SuffixAutomaton:
    """log10 probability of a symbol in a state, and the next state; rows are states."""

    code: np.ndarray  # byte to column
    logs: np.ndarray
    moves: np.ndarray
    depth: int

    @classmethod
    def fit(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, gain: float, weight: float) -> SuffixAutomaton:
        """levels[d]: contexts of d symbols (packed), next symbols and counts, for frequent contexts.

        The model is all contexts that add more than `gain` of likelihood, with the
        prefixes and suffixes that lead to them.
        """
        _, root_symbol, root_n = levels[0]
        seen = np.unique(np.append(root_symbol, END))
        width = len(seen) + 1  # the last column stands for all bytes not seen
        code = np.full(256, width - 1, dtype=np.int64)
        code[seen] = np.arange(len(seen))
        root = np.full(width, 0.5)
        np.add.at(root, code[root_symbol], root_n)
        root[-1] = 0.5 * (256 - len(seen))
        root /= root.sum()
        rare = max(1, 256 - len(seen))
        tables = [(np.zeros(1, np.int64), root[None, :].astype(np.float32))]  # contexts of a length and their distributions
        gains = []
        for d in range(1, depth + 1):
            context, symbol, n = levels[d]
            contexts, row = np.unique(context, return_inverse=True)
            upper, above = tables[-1]
            own = np.empty((len(contexts), width), dtype=np.float32)
            gained = np.empty(len(contexts))
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(0, len(contexts) + _CONTEXTS, _CONTEXTS))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part, entry = slice(i * _CONTEXTS, (i + 1) * _CONTEXTS), order[a:b]
                counts = np.zeros((len(contexts[part]), width))
                np.add.at(counts, (row[entry] - i * _CONTEXTS, code[symbol[entry]]), n[entry])
                parent = above[np.searchsorted(upper, contexts[part] & (1 << 8 * (d - 1)) - 1)].astype(np.float64)
                total = counts.sum(axis=1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gained[part] = np.where(counts > 0, counts * np.log(counts / total / parent), 0.0).sum(axis=1)
                smooth = (counts + weight * parent) / (total + weight)
                own[part] = np.where(gained[part, None] > gain, smooth, parent)
            tables.append((contexts, own))
            gains.append((contexts, gained))
        kept = [{0}, *({int(c) for c in contexts[gained > gain]} for contexts, gained in gains)]
        # with all suffixes and prefixes of kept contexts, longest first
        for d in range(depth, 1, -1):
            mask = (1 << 8 * (d - 1)) - 1
            for c in kept[d]:
                kept[d - 1].add(c & mask)
                kept[d - 1].add(c >> 8)
        number: list[dict[int, int]] = []
        states: list[tuple[int, int]] = []
        for d in range(depth + 1):
            number.append({})
            for c in sorted(kept[d]):
                number[d][c] = len(states)
                states.append((d, c))
        logs = np.zeros((len(states), width), dtype=np.float32)
        moves = np.zeros((len(states), width), dtype=np.int32)
        for s, (d, c) in enumerate(states):
            contexts, table = tables[d]
            p = table[np.searchsorted(contexts, c)].astype(np.float64)
            p[-1] /= rare
            logs[s] = np.log10(p)
            if d:
                moves[s] = moves[number[d - 1][c & (1 << 8 * (d - 1)) - 1]]
            if d < depth:
                for column, b in enumerate(seen):
                    t = number[d + 1].get(c << 8 | int(b)) if d + 1 <= depth else None
                    if t is not None:
                        moves[s, column] = t
        return cls(code.astype(np.int32), logs, moves, depth)

    def score(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its END included."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        run, begin = padded(text, offsets, self.depth)
        run = self.code[run]
        lanes = -(-size // _LANE)
        owner = np.repeat(np.arange(n), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[owner] + nth * _LANE
        length = np.minimum(_LANE, size[owner] - nth * _LANE)
        order = np.argsort(-length, kind="stable")
        at, length, owner = at[order], length[order], owner[order]
        total = np.zeros(len(at))
        state = np.zeros(len(at), dtype=np.int64)
        width = self.logs.shape[1]
        logs, moves = self.logs.ravel(), self.moves.ravel()
        live_at = np.searchsorted(-length, -np.arange(_LANE), "left")  # lanes longer than t
        for t in range(-self.depth, int(length[0]) if len(length) else 0):
            live = len(at) if t < 0 else int(live_at[t])
            place = state[:live] * width + run[at[:live] + t]
            if t >= 0:
                total[:live] += logs[place]
            state[:live] = moves[place]
        return np.bincount(owner, weights=total, minlength=n)


def _spelt(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct words, their sizes with END behind each, and their bytes with it."""
    codes, first = np.unique(words.code, return_index=True)
    start, size = words.start[first], words.end[first] - words.start[first]
    out = np.full(int(size.sum()) + len(size), END, dtype=np.uint8)
    out[runs(np.cumsum(size + 1) - size - 1, size)] = words.low[runs(start, size)]
    return codes, size + 1, out


def fit_spelling(blocks: DataFrame, *, depth: int = 3, min_share: float = 2e-5, gain: float = 10.0, weight: float = 20.0) -> SuffixAutomaton:
    """How words are spelt, from each block's distinct words in training texts.

    depth: longest context in bytes (1 to 6); min_share: least share of all places
    that a context must stand at, so that no depth has more than 1 / min_share contexts.
    With the 257 columns of 8 bytes that a state has at most, that bounds what is
    broadcast to 310 MB; texts in Latin letters take some 10 MB. gain: least
    log-likelihood that a context must add; weight: symbols that the suffix's
    distribution counts for.
    Without any text the tree is its root, with equal probabilities.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for taken, sizes, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                known, sizes, text = whole(taken, np.uint32) > 0, whole(sizes, np.uint32).astype(np.int64), whole(text, np.uint8)
                own = sizes[known]
                part = text[runs((np.cumsum(sizes) - sizes)[known], own)]
                parts.append(gram_counts(part, np.concatenate([[0], np.cumsum(own)]), depth))
                if sum(len(c) for c, _ in parts) > 1 << 20:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 1 << 19:  # what doesn't shrink goes on: the shuffle adds it up
                        yield _grams(*parts.pop())
        if parts:
            yield _grams(*merged(parts))

    grams = blocks.select("taken", "lengths", "letters").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.expr(f"gram & {(1 << 8 * (d + 1)) - 1}L").alias("g")) for d in range(depth + 1))))
    each = grams.select(levels.alias("l"), "n").groupBy("l").agg(F.sum("n").alias("n"))
    each = each.select(F.col("l.d").alias("d"), F.shiftright("l.g", 8).alias("context"), (F.col("l.g").bitwiseAND(255)).cast("int").alias("symbol"), "n")
    each = written(each)
    total = each.where("d = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = each.groupBy("d", "context").agg(F.sum("n").alias("m")).where(F.col("m") >= max(1.0, min_share * total))
    found = each.join(frequent, ["d", "context"]).select("d", "context", "symbol", "n").toArrow()
    d = found.column("d").to_numpy()
    columns = [found.column(c).to_numpy().astype(np.int64) for c in ("context", "symbol", "n")]
    return SuffixAutomaton.fit([tuple(c[d == i] for c in columns) for i in range(depth + 1)], depth, gain, weight)


def _grams(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


_BLOCKS = "block int, ids binary, flags binary, sizes binary, tokens binary, codes binary, taken binary, lengths binary, letters binary"
_BLOCK_TYPES = (pa.int32(), *[pa.binary()] * 8)
_NULL, _HELD, _TRAIN = 1, 2, 4
# Kinds of messages; those that a block sends to itself have the ranges' number added to it.
_TOKENS, _COUNTS, _TOTALS, _PLACES, _PAIRS, _SUMS, _KEPT, _SECOND, _BASE, _SCORED, _OFTEN, _RUNS, _BEHIND = range(13)  # _BEHIND and the length of the context


def _blocks(block_bytes: int):
    """Blocks of documents as numbers of their tokens among the block's distinct ones, with the letters of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number = 0, 0
        place = TaskContext.get().partitionId()
        for batch in batches:
            flags = sum(np.asarray(batch.column(c)).astype(np.uint8) * f for c, f in (("nothing", _NULL), ("held_out", _HELD), ("train", _TRAIN)))
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            body, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets):
                words = Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], VISIBLE)
                counts = np.diff(words.first)
                stop = np.cumsum(counts + 1) - 1  # each text's end among the tokens
                token = np.full(int(counts.sum()) + len(counts), _STOP, dtype=np.uint64)
                token[runs(stop - counts, counts)] = words.code
                held.append((ids[a:b], flags[a:b], (counts + 1).astype(np.uint32), token, *_spelt(words)))
                size += int(offsets[b] - offsets[a])
                if size >= block_bytes:
                    yield _block(place, number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block(place, number, held)

    return run


def _block(place: int, number: int, held: list[tuple]) -> pa.RecordBatch:
    ids, flags, sizes, token, codes, lengths, letters_ = (np.concatenate(x) for x in zip(*held, strict=True))
    every, token = np.unique(token, return_inverse=True)
    # the letters of each distinct word once, in order of the codes; the end of texts has none
    own, first = np.unique(codes, return_index=True)
    begin = np.cumsum(lengths) - lengths
    text = letters_[runs(begin[first], lengths[first])]
    length = np.zeros(len(every), dtype=np.uint32)
    length[np.searchsorted(every, own)] = lengths[first]
    # how often training texts have it
    taken = np.bincount(token[np.repeat((flags & _TRAIN) > 0, sizes)], minlength=len(every)).astype(np.uint32)
    columns = (ids, flags, sizes, token.astype(np.uint32), np.diff(every, prepend=np.uint64(0)), taken, length, text)
    # told apart by place and number: the table is written once, and never computed again
    if place >= 1 << 20 or number >= 1 << 11:
        raise ValueError("more than 2**20 partitions, or 2**11 blocks in one: take larger blocks, or partitions of another size")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([place << 11 | number], *([planes(x)] for x in columns)), _BLOCK_TYPES, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])


#: Steps of a logarithm that travels as a whole number.
_STEPS = 4096


def _rounded(log: np.ndarray) -> np.ndarray:
    return np.rint(log * -_STEPS).astype(np.uint32)


def _exact(steps: np.ndarray) -> np.ndarray:
    return steps / -float(_STEPS)


def _plus(n: np.ndarray, u: np.ndarray | int, log: np.ndarray) -> np.ndarray:
    """log10(n + u * 10 ** log), also where that power is too small for a number."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(n), np.log(u) + log * math.log(10)) / math.log(10)


def _by_key(x: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values, where each one's first entry is, which each entry has, and sums of the columns over them."""
    order = np.argsort(x)
    begin, size = groups(x[order])
    which = np.empty(len(x), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), size)
    sums = [np.add.reduceat(c[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64) for c in columns]
    return (x[order][begin], order[begin], which, *sums)


@dataclass(frozen=True)
class _Model:
    """How blocks and ranges talk, and what contexts must have.

    Tokens have numbers: the place in their range times the ranges, plus the range. A
    key is a context and, in its lowest `bits`, the number of a token; the context is the
    number of another token, or a hash of `run_bits` of several.
    """

    n_ranges: int
    gain: float
    run_bits: int = 0
    bits: int = 0
    tokens: int = 0
    distinct: int = 0
    contexts: tuple[int, ...] = (1, 3)

    def context(self, key: np.ndarray) -> np.ndarray:
        return key >> np.uint64(self.bits)

    def key(self, context: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (context << np.uint64(self.bits)) | number

    def range_of_pair(self, key: np.ndarray) -> np.ndarray:
        return hash_range(mix(key), self.n_ranges)

    def range_of_run(self, key: np.ndarray) -> np.ndarray:
        return hash_range(self.context(key) << np.uint64(64 - self.run_bits), self.n_ranges)


class _State:
    """A block and, as far as the answers in its mail go, the probability of each of its tokens."""

    def __init__(self, model: _Model, table: pa.Table, mail: pa.Table):
        self.row = {c: table.column(c)[0].as_py() for c in table.column_names}
        self.name, self.model = self.row["block"], model
        self.mail = mail.take(pa.array(np.argsort(mail.column("block").to_numpy(), kind="stable")))
        self.flags, self.tokens, self.sizes = self.column("flags", np.uint8), self.column("tokens", np.uint32), self.column("sizes", np.uint32).astype(np.int64)
        self.train = np.repeat((self.flags & _TRAIN) > 0, self.sizes)
        self.nth = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.counts, place, home = self.answer(_COUNTS, np.int64, np.uint32)
        if not len(place):  # the counts aren't needed any more
            place, home = self.answer(_PLACES, np.uint32)
        self.log = np.zeros(len(self.tokens))
        self.number = place.astype(np.uint64) * np.uint64(model.n_ranges) + home.astype(np.uint64)

    def column(self, name: str, kind: type) -> np.ndarray:
        return whole(self.row[name], kind)

    def answer(self, kind: int, *types: type) -> tuple[np.ndarray, ...]:
        """Columns of the answers, in the order in which the block's questions went to the ranges, and the ranges."""
        return read(self.mail, kind, *types)

    def by_spelling(self, spelling: SuffixAutomaton) -> None:
        """Probabilities by token counts and spelling."""
        length = self.column("lengths", np.uint32).astype(np.int64)
        spelt = np.full(len(length), math.log10(_STOP_SHARE))
        words = length > 0
        spelt[words] = spelling.score(self.column("letters", np.uint8), np.concatenate([[0], np.cumsum(length[words])])) + math.log10(1 - _STOP_SHARE)
        unseen = max(self.model.distinct, 1)
        self.log = _exact(_rounded(_plus(self.counts, unseen, spelt) - math.log10(self.model.tokens + unseen)))[self.tokens]

    def sums(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text, over some places."""
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes)[at], weights=values[at], minlength=len(self.sizes))

    def told(self, kind: int, *columns: np.ndarray) -> tuple:
        """A message to itself, beyond the ranges."""
        return (self.model.n_ranges + self.name, kind, self.name, *map(planes, columns))

    def settled(self, at: np.ndarray, later: np.ndarray) -> tuple:
        """What the places add to each text that are among `at` and not among `later`, which longer contexts go on with."""
        return self.told(_SCORED, self.sums(self.log, np.setdiff1d(at, later, assume_unique=True)))

    @cached_property
    def pairs(self) -> tuple[np.ndarray, ...]:
        """Keys of the places behind a token that training texts have twice, and their places."""
        at = np.flatnonzero(self.nth > 0)
        at = at[self.counts[self.tokens[at - 1]] >= 2]
        key = self.model.key(self.number[self.tokens[at - 1]], self.number[self.tokens[at]])
        return at, *_by_key(key, self.train[at])

    def by_pairs(self) -> None:
        at, key, _, which, _ = self.pairs
        log, often, _ = self.answer(_SECOND, np.uint32, np.uint8)
        order = np.argsort(self.model.range_of_pair(key), kind="stable")
        keys = np.empty(len(order), np.int64)  # where each key's answer is
        keys[order] = np.arange(len(order))
        self.log[at] = _exact(log)[keys][which]
        self.often = np.zeros(len(self.tokens), dtype=bool)
        self.often[at] = (often > 0)[keys][which]

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        """Keys of the places behind `length` tokens whose pairs are frequent, and their places."""
        at = np.flatnonzero(self.nth >= length)
        for i in range(1, length):
            at = at[self.often[at - i]]
        context = np.zeros(len(at), dtype=np.uint64)
        for i in range(length, 0, -1):
            context = mix(context + self.number[self.tokens[at - i]] + np.uint64(1))
        return at, *_by_key(self.model.key(context >> np.uint64(64 - self.model.run_bits), self.number[self.tokens[at]]), self.train[at])

    def by_context(self, length: int) -> np.ndarray:
        """The places behind contexts of so many tokens; their probabilities, and which pairs are frequent."""
        if length == 1:
            self.by_pairs()
            return self.pairs[0]
        self.often = np.unpackbits(self.answer(_OFTEN, np.uint8)[0], count=len(self.tokens)).astype(bool)
        at, _, _, which, _ = self.runs(length)
        self.log[at] = _exact(self.answer(_BEHIND + length, np.uint32)[0])[which]
        return at


def _ask_counts(model: _Model):
    """Training counts of a block's distinct tokens, for the ranges."""

    def run(table: pa.Table) -> pa.Table:
        codes = np.cumsum(whole(table.column("codes")[0].as_py(), np.uint64), dtype=np.uint64)
        taken = whole(table.column("taken")[0].as_py(), np.uint32)
        return mail_table(letters(hash_range(codes, model.n_ranges), _TOKENS, table.column("block")[0].as_py(), codes, taken, rising=True))

    return run


def _same_order(table: pa.Table, kind: int, answer: int, which: np.ndarray, sizes: list[int], *columns: np.ndarray) -> list[tuple]:
    """An answer to each question of a kind: the columns' values of its keys, in its order."""
    to, asked = table.column("to")[0].as_py(), [b for b, k in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind]
    ends = np.cumsum(sizes)
    return [(b, answer, to, *(planes(c[which[e - n : e]]) for c in columns)) for b, e, n in zip(asked, ends.tolist(), sizes, strict=True)]


def _sizes(block: np.ndarray) -> list[int]:
    return groups(block)[1].tolist()


def _count(table: pa.Table) -> pa.Table:
    """Counts of one range's tokens over all blocks, back to each block; and the totals."""
    codes, counts, block = read(table, _TOKENS, np.uint64, np.uint32, rising=True)
    _, _, which, total = _by_key(codes, counts)
    sums = np.array([total.sum()]), np.array([(total > 0).sum()]), np.array([len(total)])
    place = np.arange(len(total), dtype=np.uint32)
    return mail_table([*_same_order(table, _TOKENS, _COUNTS, which, _sizes(block), total, place), (-1, _TOTALS, table.column("to")[0].as_py(), *map(planes, sums))])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = ([int(whole(x, np.int64)[0]) for x in batch.column(c).to_pylist()] for c in "abc")
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "v", "most"])


def _ask_pairs(model: _Model, spelling: Broadcast):
    def run(blocks: pa.Table, mail: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return mail_table([])
        state = _State(model, blocks, mail)
        state.by_spelling(spelling.value)
        at, key, first, _, counts = state.pairs
        counts_ = state.counts[state.tokens]
        every = np.arange(len(state.tokens))
        base = state.told(_BASE, state.sums(counts_ > 0, every).astype(np.uint32), state.sums(np.log10(counts_ + 1.0), every))
        return mail_table([base, state.settled(every, at), *letters(model.range_of_pair(key), _PAIRS, state.name, key, counts.astype(np.uint32), _rounded(state.log[at[first]]), rising=True)])

    return run


def _read_keys(table: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """Distinct keys with their counts and suffix's logarithms, which one each entry has, and the questions' sizes."""
    key, counts, log, block = read(table, kind, np.uint64, np.uint32, np.uint32, rising=True)
    key, first, which, total = _by_key(key, counts)
    return key, total, _exact(log)[first], which, _sizes(block)


def _sums_of(context: np.ndarray, n: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each context with its count, its kinds of next tokens, and the sum of count * ln(count / suffix's probability); keys are sorted."""
    begin, _ = groups(context)
    if not len(begin):
        return context, n, n, log
    sums = n * (np.log(np.maximum(n, 1)) - log * math.log(10))
    return context[begin], np.add.reduceat(n, begin), np.add.reduceat((n > 0).astype(np.int64), begin), np.add.reduceat(sums, begin)


def _keep(model: _Model, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The test: twice or more, and next tokens unlike those that the suffix predicts."""
    return (n >= 2) & (sums - n * np.log(np.maximum(n, 1)) > model.gain)


def _smooth(n: np.ndarray, log: np.ndarray, place: np.ndarray, kept: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Logarithms of next tokens behind kept contexts; place: each one's context among them."""
    t, u = total[place], kinds[place]
    return np.where(kept, _plus(n, u, log) - np.log10(t + u), log)


def _part(model: _Model):
    """Sums over each context's pairs in one range, for the range of the context."""

    def run(table: pa.Table) -> pa.Table:
        key, n, log, _, _ = _read_keys(table, _PAIRS)
        context, total, kinds, sums = _sums_of(model.context(key), n, log)
        return mail_table(letters(hash_range(mix(context), model.n_ranges), _SUMS, table.column("to")[0].as_py(), context, total.astype(np.int64), kinds.astype(np.int64), sums.astype(np.float64), rising=True))

    return run


def _decide(model: _Model):
    """Which contexts are kept, back to all ranges that have pairs of them."""

    def run(table: pa.Table) -> pa.Table:
        context, total, kinds, sums, block = read(table, _SUMS, np.uint64, np.int64, np.int64, np.float64, rising=True)
        _, _, which, t, u = _by_key(context, total, kinds)
        s = np.bincount(which, weights=sums, minlength=len(t))
        kept = _keep(model, t, s)[which]
        return mail_table(letters(block[kept], _KEPT, table.column("to")[0].as_py(), context[kept], t[which][kept], u[which][kept], rising=True))

    return run


def _answer_pairs(model: _Model):
    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return mail_table([])
        key, n, log, which, sizes = _read_keys(asked, _PAIRS)
        context, total, kinds, _ = read(told, _KEPT, np.uint64, np.int64, np.int64, rising=True)
        order = np.argsort(context)
        context, total, kinds = context[order], total[order], kinds[order]
        if len(context):
            at = np.minimum(np.searchsorted(context, model.context(key)), len(context) - 1)
            log = _smooth(n, log, at, context[at] == model.context(key), total, kinds)
        return mail_table(_same_order(asked, _PAIRS, _SECOND, which, sizes, _rounded(log), (n >= 2).astype(np.uint8)))

    return run


def _ask_runs(model: _Model, before: int, length: int):
    """before: the next shorter context, whose probability a place behind frequent tokens falls to; others have theirs."""

    def run(blocks: pa.Table, mail: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return mail_table([])
        state = _State(model, blocks, mail)
        known = state.by_context(before)
        at, key, first, _, counts = state.runs(length)
        own = [state.settled(known, at)]
        if before == 1:
            own.append(state.told(_OFTEN, np.packbits(state.often)))
        return mail_table(own + letters(model.range_of_run(key), _RUNS, state.name, key, counts.astype(np.uint32), _rounded(state.log[at[first]]), rising=True))

    return run


def _answer_runs(model: _Model, length: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("to")[0].as_py() >= model.n_ranges:  # from a block to itself
            return table.set_column(0, "to", table.column("block"))
        key, n, log, which, sizes = _read_keys(table, _RUNS)
        context = model.context(key)
        own, total, kinds, sums = _sums_of(context, n, log)
        if len(own):
            at = np.minimum(np.searchsorted(own, context), len(own) - 1)
            log = _smooth(n, log, at, (own[at] == context) & _keep(model, total, sums)[at], total, kinds)
        return mail_table(_same_order(table, _RUNS, _BEHIND + length, which, sizes, _rounded(log)))

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _score(model: _Model):
    def run(blocks: pa.Table, mail: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(_SCORES.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        state = _State(model, blocks, mail)
        last = state.by_context(model.contexts[-1])
        known, logs, _ = state.answer(_BASE, np.uint32, np.float64)
        before = state.answer(_SCORED, np.float64)[0].reshape(-1, len(state.sizes))
        return pa.table(
            {
                "doc_id": pa.array(state.column("ids", np.int64), mask=(state.flags & _NULL) > 0),
                "held_out": pa.array((state.flags & _HELD) > 0),
                "n_tokens": pa.array(state.sizes),
                "n_known": pa.array(known.astype(np.int64)),
                "logs": pa.array(logs),
                "score": pa.array(before.sum(axis=0) + state.sums(state.log, last)),
            }
        )

    return run


def score_texts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    of: int = 7,
    fold: int = 2,
    gain: float = 10.0,
    contexts: tuple[int, ...] = (1, 3),
    block_bytes: int = 8 << 20,
    spelling: SuffixAutomaton | None = None,
) -> DataFrame:
    """log10 probabilities of all whole texts, under the suffix tree and under token counts.

    Learns from the texts whose crc32(id as text) modulo `of` is not `fold`; a null
    id is never held out. gain: least log-likelihood that a context must add to be
    kept. contexts: lengths of contexts in tokens, rising from 1; a suffix tree without
    gaps has all of them, as (1, 2, 3). Null text counts as empty: one end token. Repeated rows are scored, and
    counted, as often as they stand. An empty table gives no rows; other columns don't
    matter; a text of any length is used as a whole. Tokens, and contexts of several, are
    told apart by hashes, of 64 and of 32 bits or more; logarithms travel in steps of 1/4096.
    """
    if contexts[:1] != (1,) or any(a >= b for a, b in zip(contexts, contexts[1:], strict=False)):
        raise ValueError("contexts must rise from 1")
    spark = docs.sparkSession
    held = held_out(id_col, of, fold)
    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"), (~held).alias("train"), number.isNull().alias("nothing"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = Step(rows.mapInArrow(_blocks(block_bytes), _BLOCKS))
    spelling = spark.sparkContext.broadcast(fit_spelling(blocks.df) if spelling is None else spelling)
    model = _Model(max(8, -(-size // block_bytes)), gain)
    block, to = lambda *columns: blocks.df.select("block", *columns).groupBy("block"), lambda mail: mail.groupBy("to")
    texts = ("flags", "sizes", "tokens")
    counted = Step(to(block("codes", "taken").applyInArrow(_ask_counts(model), MAIL)).applyInArrow(_count, MAIL))
    release(spark)
    total = lambda f, c: F.coalesce(f(c), F.lit(0))
    tokens, distinct, most = counted.df.where("to < 0").mapInArrow(_totals, "n long, v long, most long").agg(total(F.sum, "n"), total(F.sum, "v"), total(F.max, "most")).first()
    bits = max(1, (most * model.n_ranges).bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 distinct tokens")
    model = _Model(model.n_ranges, gain, min(64 - bits, max(32, size.bit_length() + 8)), bits, tokens, distinct, contexts)
    counts = counted.df.where("to >= 0")
    asked = Step(block(*texts, "lengths", "letters").cogroup(to(counts)).applyInArrow(_ask_pairs(model, spelling), MAIL))
    # what spelling and counting took isn't needed any more
    slim = Step(blocks.df.select("block", "ids", *texts))
    blocks.drop()
    blocks = slim
    release(spark)
    pairs, own = asked.df.where(F.col("to") < model.n_ranges), asked.df.where(F.col("to") >= model.n_ranges).withColumn("to", F.col("block"))
    kept = to(to(pairs).applyInArrow(_part(model), MAIL)).applyInArrow(_decide(model), MAIL)
    last = Step(to(pairs).cogroup(to(kept)).applyInArrow(_answer_pairs(model), MAIL))
    told = [Step(own)]
    asked.drop()
    release(spark)
    # what is known of the places that longer contexts go on with; the others' sums are told
    own = F.col("kind").isin(_SCORED, _OFTEN)
    known = counts
    places = counts.select("to", F.lit(_PLACES).alias("kind"), "block", F.col("b").alias("a"), *(F.lit(b"").alias(c) for c in "bcde"))
    for before, length in zip(contexts, contexts[1:], strict=False):
        runs_ = block(*texts).cogroup(to(known.unionByName(last.df.where(~own)))).applyInArrow(_ask_runs(model, before, length), MAIL)
        step = Step(to(runs_).applyInArrow(_answer_runs(model, length), MAIL))
        last.drop()
        last, known = step, places
        told.append(Step(last.df.where(own)))
        for step in told:
            known = known.unionByName(step.df.where(F.col("kind") == _OFTEN))
        del runs_
        release(spark)
    known = (counts if len(contexts) == 1 else places).unionByName(last.df.where(~own))
    for step in told:
        known = known.unionByName(step.df)
    scored = written(block("ids", *texts).cogroup(to(known)).applyInArrow(_score(model), _SCORES))
    for step in (blocks, counted, last, *told):
        step.drop()
    release(spark)
    totals = (tokens, distinct)
    base = F.col("logs") - F.col("n_tokens") * math.log10(sum(totals) + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
