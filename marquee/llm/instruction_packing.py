"""Vector bin packing of examples into training sequences, by the dot-product heuristic.

A sequence has room for `tokens` tokens, `segments` pieces and `loss` loss-bearing tokens at once. It is filled
piece by piece: of those that fit, the one whose vector (each measure as a share of its limit) has the greatest dot
product with the room that is left goes in. Large pieces meet large rooms, and pieces that are short of the scarce
measure come when it runs out. A piece that fills a sequence on its own has the greatest product of all.

Where pieces may be cut, what is left of a sequence when nothing fits takes the head of the piece with the greatest
product, and the rest of that piece waits on. A sequence that can't be filled (too many tiny segments, or the last
of a task) is cut back to the greatest power of two, a length that needs no padding, and what is over waits on.

A task packs the rows of its own input partition through a pool of at most `POOL` waiting pieces: nothing is
shuffled, memory is bounded, and a task that is run again packs alike. Only a task's last sequences are short.
Sequence ids are those of the task, TASK_STEP apart, counted up.

Defined cases: null and empty texts are the end id alone; an example without tokens, or without ids, has no piece;
an uncut example beyond a limit has no sequence (null); a null loss mask bears loss everywhere, and so do ids beyond
a short mask; repeated rows are examples of their own; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_slices
from .token_output import END_ID, SLICE_CHARS, encoder

POOL = 1024
TASK_STEP = 1 << 40
SCHEMA = "id long, start long, length long, ids binary, total long, loss_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


def padded(length: int, tokens: int) -> int:
    """Length of a sequence in the batch: itself at a power of two, else that of a full one."""
    return length if length & (length - 1) == 0 else tokens


class Piece(NamedTuple):
    """Ids `start` to `stop` of an example; bearing[k] of its first k ids bear loss (None: all)."""

    id: int | None
    ids: np.ndarray
    bearing: np.ndarray | None
    start: int
    stop: int
    first: int  # place of ids[0] in the example
    total: int

    @property
    def length(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return self.length if self.bearing is None else int(self.bearing[self.stop] - self.bearing[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """Ids of the longest head within tokens and loss."""
        if self.bearing is None:
            return min(self.length, tokens, loss)
        return min(self.length, tokens, int(np.searchsorted(self.bearing, self.bearing[self.start] + loss, "right")) - 1 - self.start)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return self._replace(stop=self.start + length), self._replace(start=self.start + length)


class Packer:
    """Packs pieces in the order they come, POOL of them waiting at most."""

    def __init__(self, limits: Limits, cut: bool, pool: int = POOL):
        self.limits, self.may_cut, self.pool = limits, cut, pool
        self.waiting: list[Piece | None] = []
        self.free: list[int] = []
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.waiting) - len(self.free)

    def put(self, piece: Piece) -> None:
        if not self.free:
            more = max(16, len(self.waiting))
            self.free = list(range(len(self.waiting) + more - 1, len(self.waiting) - 1, -1))
            self.waiting += [None] * more
            self.tokens, self.loss = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.tokens, self.loss))
        k = self.free.pop()
        self.waiting[k], self.tokens[k], self.loss[k] = piece, piece.length, piece.loss

    def take(self, k: int) -> Piece:
        piece, self.waiting[k], self.tokens[k] = self.waiting[k], None, 0
        self.free.append(k)
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Full sequences that a new piece brings about."""
        top = self.limits
        if self.may_cut:
            while piece.length >= top.tokens and piece.most(top.tokens, top.loss) == top.tokens:
                head, piece = piece.cut(top.tokens)
                yield [head]
        if piece.length:
            self.put(piece)
        while len(self) >= self.pool:
            yield self.sequence()

    def rest(self) -> Iterator[list[Piece]]:
        while len(self):
            yield self.sequence()

    def sequence(self) -> list[Piece]:
        """The pieces of one more sequence; at least one id leaves the pool."""
        top, out = self.limits, []
        tokens, segments, loss = top
        while tokens and segments:
            here = self.tokens > 0
            product = self.tokens * (tokens / top.tokens ** 2) + self.loss * (loss / top.loss ** 2) + segments / top.segments ** 2
            fits = here & (self.tokens <= tokens) & (self.loss <= loss)
            if fits.any():
                piece = self.take(int(np.where(fits, product, -1).argmax()))
            else:
                if not self.may_cut or not here.any():
                    break
                k = int(np.where(here, product, -1).argmax())
                length = self.waiting[k].most(tokens, loss)
                if not length:
                    break
                piece, over = self.take(k).cut(length)
                self.put(over)
            out.append(piece)
            tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.loss
        used = top.tokens - tokens
        if self.may_cut and used:
            over = used - (1 << used.bit_length() - 1) if padded(used, top.tokens) != used and used < top.tokens else 0
            while over:
                piece = out.pop()
                if piece.length > over:
                    piece, tail = piece.cut(piece.length - over)
                    out.append(piece)
                    self.put(tail)
                    break
                self.put(piece)
                over -= piece.length
        return out


def rows_of(sequence: list[Piece], sequence_id: int | None) -> Iterator[tuple]:
    offset = 0
    for p in sequence:
        yield (p.id, p.first + p.start, p.length, p.ids[p.start:p.stop].astype("<u4").tobytes(), p.total, p.loss, sequence_id, offset)
        offset += p.length


def packing(pieces_of: Callable, limits: Limits, cut: bool, pool: int) -> Callable:
    """The function of one task: pieces_of(batch) gives the examples of a batch in slices, as lists of pieces."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = Packer(limits, cut, pool), TaskContext.get().partitionId() * TASK_STEP
        for batch in batches:
            for pieces in pieces_of(batch):
                rows: list[tuple] = []
                for piece in pieces:
                    if not cut and (piece.length > limits.tokens or piece.loss > limits.loss):
                        rows += rows_of([piece], None)
                        continue
                    for sequence in packer.add(piece):
                        rows += rows_of(sequence, at)
                        at += 1
                yield batch_of(rows)
        rows = []
        for sequence in packer.rest():
            rows += rows_of(sequence, at)
            at += 1
        yield batch_of(rows)

    return run


def packed(examples: DataFrame, limits: Limits = Limits(), cut: bool = False, pool: int = POOL) -> DataFrame:
    """Pieces of examples (id, ids array<int>, loss array<boolean> or null) in sequences, whole unless `cut`.

    id, start (of the piece in its example), length, ids (32-bit, little-endian), total (ids of the example),
    loss_tokens, sequence_id and offset (in the sequence, gapless from 0).
    """

    def pieces_of(batch: pa.RecordBatch) -> Iterator[list[Piece]]:
        out = []
        for id_, ids, mask in zip(*[c.to_pylist() for c in batch.columns]):
            if ids:
                bearing = None
                if mask is not None:
                    kept = [m is not False for m in mask[:len(ids)]]
                    bearing = np.concatenate([[0], np.cumsum(kept + [True] * (len(ids) - len(kept)))])
                out.append(Piece(id_, np.array(ids, "<u4"), bearing, 0, len(ids), 0, len(ids)))
        yield out

    rows = examples.select(F.col("id").cast("long"), F.col("ids").cast("array<int>"), F.col("loss").cast("array<boolean>"))
    return in_arrow(rows, packing(pieces_of, limits, cut, pool), SCHEMA)


def packed_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Like `packed` with cuts, for documents (doc_id, text): encoded, with the end id after each, all ids bearing loss."""

    def pieces_of(batch: pa.RecordBatch) -> Iterator[list[Piece]]:
        coder = encoder(tokenizer)
        for start, texts in text_slices(batch, 1, SLICE_CHARS):
            ids, lengths = coder.encode(texts, end_id)
            doc_ids = batch.column(0).slice(start, len(texts)).to_pylist()
            at, out = 0, []
            for id_, n in zip(doc_ids, lengths.tolist()):
                full = n - n % limits.tokens if limits.loss >= limits.tokens else 0
                if full:
                    out.append(Piece(id_, ids[at:at + full], None, 0, full, 0, n))
                if n > full:  # a copy: what waits must not hold the ids of the whole slice
                    out.append(Piece(id_, ids[at + full:at + n].copy(), None, 0, n - full, full, n))
                at += n
            yield out

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), packing(pieces_of, limits, True, pool), SCHEMA)
