"""Vector bin packing of token sequences for instruction data.

A sequence keeps three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens. Each task packs
the documents of its partition from a pool of bounded size. The next piece of a sequence is the one with the largest
dot product of its needs and what is left of the limits; where none fits whole, the best one is cut at what is left.
A sequence that a limit ends early is cut at powers of two, which need no padding; all others are full.

Every id lies in exactly one piece; offsets in a sequence are gapless from 0. Null and empty texts have the end id
alone; empty token lists have no piece. Very long texts are cut as they come, one at a time. Repeated rows are packed each on
their own; a null id stays null. Of pieces that fit equally well the one that came first into its place in the pool is taken. Results are
the same whenever a task's rows come in the same order, as from files. Sequence ids are unique, not dense: the
partition's number, then a counter. Empty tables give no pieces. Further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_texts
from .workers import tidy


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


@dataclass
class Piece:
    document: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None  # one flag a token; None: all bear loss
    total: int

    def bearing(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """The length of the longest head within the limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(np.cumsum(self.loss), loss, side="right")))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        rest = None if self.loss is None else self.loss[n:]
        return Piece(self.document, self.start, self.ids[:n], None if self.loss is None else self.loss[:n], self.total), Piece(self.document, self.start + n, self.ids[n:], rest, self.total)


class Packer:
    """Takes documents one by one and gives sequences, each a list of pieces."""

    POOL = 1024

    def __init__(self, limits: Limits):
        self.limits = limits
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Piece | None] = [None] * (2 * self.POOL)
        self.need = np.full((2 * self.POOL, 3), np.inf)
        self.free = list(range(2 * self.POOL))[::-1]

    def put(self, piece: Piece) -> None:
        if not self.free:
            self.free = list(range(2 * len(self.pool)))[: len(self.pool) - 1 : -1]
            self.need = np.vstack([self.need, np.full((len(self.pool), 3), np.inf)])
            self.pool += [None] * len(self.pool)
        at = self.free.pop()
        self.pool[at] = piece
        self.need[at] = (len(piece.ids), 1, piece.bearing())

    def take(self, at: int) -> Piece:
        piece, self.pool[at] = self.pool[at], None
        self.need[at] = np.inf
        self.free.append(at)
        return piece

    def held(self) -> int:
        return len(self.pool) - len(self.free)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.limits.tokens or piece.bearing() > self.limits.loss:
            n = piece.fitting(self.limits.tokens, self.limits.loss)
            head, piece = piece.cut(n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self.put(head)
        if len(piece.ids):
            self.put(piece)
        if self.held() >= self.POOL:
            while self.held() > self.POOL // 2:
                yield from self.sequence()

    def sequence(self) -> Iterator[list[Piece]]:
        """Fills one sequence from the pool."""
        own: list[Piece] = []
        left = self.most.copy()
        while left.min() >= 1 and self.held():
            gain = np.where((self.need <= left).all(axis=1), (np.where(np.isinf(self.need), 0, self.need) / self.most) @ (left / self.most), -1.0)
            at = int(gain.argmax())
            if gain[at] > 0:
                piece = self.take(at)
            else:  # none fits whole: what fits of the best one
                clipped = np.where(np.isinf(self.need), 0, np.minimum(self.need, left))
                at = int(((clipped / self.most) @ (left / self.most)).argmax())
                n = self.pool[at].fitting(int(left[0]), int(left[2]))
                if n == 0:
                    break
                piece, rest = self.take(at).cut(n)
                if len(rest.ids):
                    self.put(rest)
            own.append(piece)
            left -= (len(piece.ids), 1, piece.bearing())
        yield from self.without_padding(own)

    def without_padding(self, own: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence that isn't full is cut into sequences of descending powers of two."""
        length = sum(len(p.ids) for p in own)
        if length == self.limits.tokens:
            yield own
            return
        own = own[::-1]
        for bit in range(length.bit_length() - 1, -1, -1):
            if size := length & (1 << bit):
                part: list[Piece] = []
                while size:
                    piece = own.pop()
                    if len(piece.ids) > size:
                        piece, rest = piece.cut(size)
                        own.append(rest)
                    part.append(piece)
                    size -= len(piece.ids)
                yield part

    def finish(self) -> Iterator[list[Piece]]:
        while self.held():
            yield from self.sequence()


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@tidy()
def _packed(batches, tokens_of: Callable, limits: Limits, id_type: pa.DataType | None, with_ids: bool):
    packer, serial, base, rows = Packer(limits), 0, TaskContext.get().partitionId() << 36, []
    kind: list = []

    def flush():
        columns = list(zip(*rows))
        types = [kind[0], *[pa.int64()] * 7] + [pa.binary()] * with_ids
        names = ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))] + ["ids"] * with_ids
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def put(sequences):
        nonlocal serial
        for own in sequences:
            at = 0
            for p in own:
                raw = p.ids.astype("<u4").tobytes()
                row = (p.document, p.start, len(p.ids), zlib.crc32(raw), p.total, base + serial, at, p.bearing())
                rows.append(row + (raw,) if with_ids else row)
                at += len(p.ids)
            serial += 1

    for batch in batches:
        kind[:] = [batch.column(0).type]
        for document, ids, loss in tokens_of(batch):
            put(packer.add(Piece(document, 0, ids, loss, len(ids))))
            if len(rows) >= 1000:
                yield flush()
    put(packer.finish())
    if rows:
        yield flush()


def _schema(df: DataFrame, id_col: str, with_ids: bool) -> str:
    return f"doc_id {df.schema[id_col].dataType.simpleString()}, {COLUMNS}" + ", ids binary" * with_ids


def pack_texts(documents: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]), a row a piece.

    tokenizer: path of a file of the tokenizers library, the same on every executor. All ids bear loss. No shuffle.
    """

    def tokens_of(batch):
        from .tokenizing import encoder

        ends, texts = np.array([end_id], "<u4"), batch.column(1)
        for at in range(0, len(texts), 256):
            for document, ids in zip(batch.column(0)[at : at + 256].to_pylist(), encoder(tokenizer).encode(texts[at : at + 256].to_pylist())):
                yield document, np.concatenate([ids, ends]), None

    long_texts(documents.sparkSession)
    plain = documents.select(F.col(id_col), F.col(text_col))
    return plain.mapInArrow(lambda b: _packed(b, tokens_of, limits, None, with_ids), _schema(documents, id_col, with_ids))


def pack_ids(examples: DataFrame, *, id_col: str, ids_col: str, loss_col: str | None = None, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """The same for examples that are tokenized already; loss_col holds a boolean for each id (null: all bear loss)."""

    def tokens_of(batch):
        for i in range(batch.num_rows):
            ids = np.array(batch.column(1)[i].as_py() or [], "<u4")
            loss = batch.column(2)[i].as_py() if loss_col else None
            if loss is not None and len(loss) != len(ids):
                raise ValueError(f"{len(loss)} loss flags for {len(ids)} ids")
            yield batch.column(0)[i].as_py(), ids, None if loss is None else np.array(loss, bool)

    plain = examples.select(F.col(id_col), F.col(ids_col), *([F.col(loss_col)] if loss_col else []))
    return plain.mapInArrow(lambda b: _packed(b, tokens_of, limits, None, with_ids), _schema(examples, id_col, with_ids))
