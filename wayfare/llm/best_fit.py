"""Best-two-fit packing: whole documents into as few sequences of `size` tokens as they go.

Only documents longer than a sequence are cut, into pieces of its size, of which the last may be shorter. A sequence is
filled greedily with the longest pieces that fit; then its shortest piece makes way for two others, if two of those left fill
the gap that this opens more tightly (no piece left fits what remains, nor does the one that made way).

Pieces of one length are alike, so packing needs only their numbers, `size` whole numbers that Spark counts however
many documents there are. Equal sequences follow each other, and the driver plans them at once: a plan line is a
sequence's lengths and how often it comes. Each line uses up a length's supply for its pattern, so that there are a few
thousand lines at most. Every piece then finds its own place, as it knows how many of its length come before it: in its
task, from when it was made, and in earlier tasks, from the sums of their counts. Texts are never shuffled, and rows of pieces
only where those sums are too many to be broadcast.

Null and empty texts are the end id alone. Very long texts are cut as they come, one at a time. Repeated rows, and rows
without an id, are packed each on their own; which of several pieces of one length gets which place depends on the order of
rows only. An empty table gives no rows. Further columns are ignored, whatever they are called. Sequence numbers are dense
from 0; offsets in a sequence are gapless from 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import few, long_texts, materialise
from .workers import tidy

SIZE = 4096


@dataclass(frozen=True)
class Line:
    """`times` sequences of the same lengths: (length, pieces of it in a sequence), longest first."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def _filled(counts: np.ndarray, gap: int, own: dict[int, int]) -> int:
    """Takes the longest pieces that fit, again and again; returns what is left of the gap."""
    while gap:
        fits = np.flatnonzero(counts[1 : gap + 1])
        if not len(fits):
            break
        length = int(fits[-1]) + 1
        n = min(gap // length, int(counts[length]))
        own[length] = own.get(length, 0) + n
        counts[length] -= n
        gap -= n * length
    return gap


def _better_two(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two pieces left whose sum is the largest up to the gap; of equal sums the one with the longer piece."""
    lengths = np.flatnonzero(counts[:gap])
    if not len(lengths):
        return None
    # the longest second piece for each first one
    at = np.searchsorted(lengths, gap - lengths, side="right") - 1
    second = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    twice = (second == lengths) & (counts[lengths] < 2)
    second = np.where(twice, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), second)
    total = np.where(second > 0, lengths + second, 0)
    best = int(total.max())
    if not best:
        return None
    k = int(np.flatnonzero(total == best)[-1])
    return int(lengths[k]), int(second[k])


def plan(counts: np.ndarray, size: int = SIZE) -> list[Line]:
    """The sequences for counts[length] pieces of each length up to size, as if they were packed one by one."""
    counts = np.array(counts, np.int64)
    if len(counts) != size + 1 or counts[0] or (counts < 0).any():
        raise ValueError("counts go from 0 to size, and no piece is empty")
    lines = []
    while counts.any():
        own: dict[int, int] = {}
        left = counts.copy()
        gap = _filled(left, size, own)
        if gap and left.any():
            shortest = min(own)
            two = _better_two(left, gap + shortest)
            if two and sum(two) > shortest:
                own[shortest] -= 1
                for length in two:
                    own[length] = own.get(length, 0) + 1
        lengths = tuple(sorted(((n, k) for n, k in own.items() if k), reverse=True))
        times = min(int(counts[n]) // k for n, k in lengths)
        for n, k in lengths:
            counts[n] -= times * k
        lines.append(Line(lengths, times))
    return lines


class Places:
    """The place of the n-th piece of a length under a plan."""

    def __init__(self, lines: list[Line], size: int):
        runs: list[tuple[int, int, int, int, int]] = []
        used = [0] * (size + 1)
        sequence = 0
        for line in lines:
            offset = 0
            for length, k in line.lengths:
                runs.append((length, used[length], k, sequence, offset))
                used[length] += line.times * k
                offset += length * k
            sequence += line.times
        own = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.first, self.each, self.sequence, self.offset = own[:, 1], own[:, 2], own[:, 3], own[:, 4]
        self.edges = np.searchsorted(own[:, 0], np.arange(size + 2))

    def __call__(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces."""
        run = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own, (a, b) = length == n, self.edges[n : n + 2]
            run[own] = a + np.searchsorted(self.first[a:b], nth[own], side="right") - 1
        step = nth - self.first[run]
        return self.sequence[run] + step // self.each[run], self.offset[run] + step % self.each[run] * length


_PIECE = "piece int, start long, length long, ids_crc32 long"


@tidy()
def _pieces(batches, tokenizer: str, end_id: int, size: int, with_ids: bool):
    """Pieces as they come, with their task and how many of their length it made before."""
    from .tokenizing import encoder

    made, task, ends = np.zeros(size + 1, np.int64), TaskContext.get().partitionId(), np.array([end_id], "<u4")
    for batch in batches:
        texts = batch.column(1)
        for at in range(0, len(texts), 256):
            names, rows = batch.column(0)[at : at + 256], []
            for row, ids in enumerate(encoder(tokenizer).encode(texts[at : at + 256].to_pylist())):
                ids = np.concatenate([ids, ends])
                for piece, start in enumerate(range(0, len(ids), size)):
                    raw = ids[start : start + size].astype("<u4").tobytes()
                    length = len(raw) // 4
                    rows.append((row, piece, start, length, zlib.crc32(raw), task, made[length], *([raw] if with_ids else [])))
                    made[length] += 1
            columns = list(zip(*rows))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [names.take(pa.array(columns[0], pa.int32())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: len(arrays)])


def pack_texts(documents: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row a piece.

    tokenizer: path of a file of the tokenizers library, the same on every executor.
    """
    if size < 1:
        raise ValueError("a sequence holds at least one token")
    long_texts(documents.sparkSession)
    kind = f"doc_id {documents.schema[id_col].dataType.simpleString()}, {_PIECE}, task int, nth long" + ", ids binary" * with_ids
    own = documents.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda b: _pieces(b, tokenizer, end_id, size, with_ids), kind)
    return placed(materialise(own, "pieces"), size)


def placed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset in place of task and nth; pieces: a written table, length, task and nth among its columns."""
    by_task = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length, `size` at most
        counts[r["length"]] = r["n"]
    places = Places(plan(counts, size), size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = materialise(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "piece-places")
    numbered = pieces.join(few(earlier), ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task")
    kept = [c for c in pieces.columns if c not in ("task", "nth")]

    def find(batches):
        for batch in batches:
            sequence, offset = places(batch["length"].to_numpy(), batch["nth"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kind = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.mapInArrow(find, f"{kind}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences of pack_texts(..., with_ids=True), ids as little-endian unsigned 32-bit numbers.

    A group is one sequence, so it holds `size` tokens at most.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))
