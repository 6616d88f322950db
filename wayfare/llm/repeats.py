"""Removal of repeated byte strings by distributed prefix doubling.

Ranks tell equal strings: positions whose strings of some width are equal share a rank. Doubling makes ranks of twice the
width from pairs (rank here, rank further on). It runs inside a task, on 64-bit names that agree on every executor, as
far as no position need be told unique; then in rounds over the whole corpus:

1. A sample of positions: those whose name of `gram` bytes (a third of the length, down to a power of two) is the
   smallest of some window of `length` bytes (winnowing). Equal windows have the same smallest name at the same place, so
   every repeated window holds a sampled position whose name repeats. Spark sorts the sample by name; positions with a
   unique name leave. Of positions whose surroundings (every byte that a window around them can hold) are equal, the
   first stands for all: the others' windows are copies of its windows and repeat. If all of a name's positions have equal
   surroundings they are settled; else the first of each surroundings is open.
2. The windows around open positions, in rounds: Spark sorts their ranks of twice the gram, then pairs (rank, name of the
   rest) at offsets that double until the pair covers `length` bytes. After each sort equal pairs get a new rank, and a
   window whose rank is unique leaves. Of those that still share a rank past the last offset all but the earliest repeat.

Positions travel packed, dealt into buckets by the value that they are sorted by, so that a row of the shuffle holds
thousands. Before a sort a task keeps the first of its own equal windows, and two of the surroundings of a name, so that a
name that a third of all documents share reaches a sort a few times a task. Shuffles have as many parts as the texts' bytes need.

Matches never cross documents; order is by document id (nulls last; rows that share an id by a hash of their text), then
start. Every row is a document of its own. Null texts are empty; documents shorter than `length` have no match. Very
long texts are worked on in segments that overlap. An empty table gives an empty result. Other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_texts, materialise, own_keys
from .workers import large, small, tidy

SEGMENT, TOGETHER = 1 << 20, 1 << 19
#: Bytes of a shuffle's part, and names in a bucket.
PART, BUCKET = 96 << 20, 500_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype("<u8")


@dataclass(frozen=True)
class Shape:
    """The widths that a length of repeats asks for."""

    length: int = 100

    def __post_init__(self) -> None:
        if self.length < 1:
            raise ValueError("the length must be at least 1")

    @cached_property
    def gram(self) -> int:
        return 1 << max(0, (self.length // 3).bit_length() - 1)

    @property
    def back(self) -> int:
        """Starts that a window can have before a gram that it holds; it reaches `length` bytes after the gram's start."""
        return self.length - self.gram

    @cached_property
    def widths(self) -> list[int]:
        """The widths of the ranks that the rounds sort."""
        found = [min(2 * self.gram, self.length)]
        while found[-1] < self.length:
            found.append(min(2 * found[-1], self.length))
        return found

    @cached_property
    def around(self) -> list[int]:
        """Places of names of two grams that cover the surroundings of a gram."""
        last = self.length - min(2 * self.gram, self.length)
        return [*range(-self.back, last, 2 * self.gram), last]


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the strings that two neighbouring names make."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def grams(raw: np.ndarray, width: int) -> np.ndarray:
    """The name of the `width` bytes (a power of two) at each position where they fit, by doubling."""
    names, offset = _BYTES[raw], 1
    while offset < width:
        names = _paired(names[:-offset], names[offset:])
        offset *= 2
    return names


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every `width` neighbours, also by doubling."""
    best, n = (np.minimum if least else np.maximum), 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


class Piece:
    """A part of a document with the margins that its own positions need."""

    def __init__(self, row: int, raw: bytes, begin: int, end: int, shape: Shape):
        self.row, self.total = row, len(raw)
        self.low, self.high = max(0, begin - shape.back), min(len(raw), end + shape.length)
        self.begin, self.end, self.raw = begin, end, raw


def pieces(texts: list[bytes], shape: Shape):
    """Groups of pieces of about TOGETHER bytes."""
    group, size = [], 0
    for row, raw in enumerate(texts):
        if len(raw) < shape.length:
            continue
        for begin in range(0, len(raw), SEGMENT):
            piece = Piece(row, raw, begin, min(len(raw), begin + SEGMENT), shape)
            if piece.high - piece.low < shape.length:
                continue
            group.append(piece)
            size += piece.high - piece.low
            if size >= TOGETHER:
                yield group
                group, size = [], 0
    if group:
        yield group


class Named:
    """Names over a group of pieces laid end to end: grams, smallest gram of each window, and each byte's piece."""

    def __init__(self, group: list[Piece], shape: Shape):
        sizes = np.array([p.high - p.low for p in group])
        self.group, self.shape, self.starts = group, shape, np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(p.raw[p.low : p.high] for p in group), np.uint8)
        self.gram = grams(raw, shape.gram)
        ends = self.starts + sizes
        for end in ends[:-1]:  # grams that would cross into the next piece
            self.gram[end - shape.gram + 1 : end] = _TOP
        self.least = _sliding(self.gram, shape.back + 1, True)  # by start of window
        self.valid = np.ones(len(self.least), bool)
        for end in ends[:-1]:
            self.valid[end - shape.length + 1 : end] = False

    def anchors(self) -> np.ndarray:
        """Positions whose gram is the smallest of a window that holds it."""
        shown, back = np.where(self.valid, self.least, np.uint64(0)), self.shape.back
        padded = np.concatenate([np.zeros(back, "<u8"), shown, np.zeros(back, "<u8")])
        return np.flatnonzero(_sliding(padded, back + 1, False) == self.gram)

    def named(self, at: np.ndarray, width: int) -> np.ndarray:
        """Names of `width` bytes, from names of half of them, which overlap where the width is no double."""
        half = self.shape.gram
        if width == half:
            return self.gram[at]
        while 2 * half < width:
            half *= 2
        return _paired(self.named(at, half), self.named(at + width - half, half))

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        width = self.shape.widths[0]
        name = self.named(at + self.shape.around[0], width)
        for place in self.shape.around[1:]:
            name = _paired(name, self.named(at + place, width))
        return name


def _sampled(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, gram and name of the surroundings of each sampled position, by row and position."""
    rows, places, names, around = [], [], [], []
    back, ahead = shape.back, shape.length
    for group in pieces(texts, shape):
        named = Named(group, shape)
        at = named.anchors()
        which = np.searchsorted(named.starts, at, side="right") - 1
        low, begin, end, total, row = (np.array([getattr(p, k) for p in group])[which] for k in ("low", "begin", "end", "total", "row"))
        place = at - named.starts[which] + low
        own = (place >= begin) & (place < end)
        at, place, total, row, which = at[own], place[own], total[own], row[own], which[own]
        name, inner = named.gram[at], (place >= back) & (place + ahead <= total)
        context = np.zeros(len(at), "<u8")
        context[inner] = named.surroundings(at[inner])
        for i in np.flatnonzero(~inner):
            raw, p = group[which[i]].raw, int(place[i])
            a, b = max(0, p - back), min(len(raw), p + ahead)
            context[i] = xxhash.xxh64_intdigest(raw[a:b], (p - a) * (ahead + 1) + b - p)
        rows.append(row), places.append(place), names.append(name), around.append(context)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, "<u8"), np.zeros(0, "<u8")
    return tuple(np.concatenate(x) for x in (rows, places, names, around))


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view("<i8") if x.dtype.kind == "u" else x.astype("<i8"), pa.int64()) for x in columns.values()], list(columns))


#: What a row of the first sort says: a pair to be sorted, one known to repeat, one known to be open.
SORT, REPEATS, OPEN = 0, 1, 2


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Which rows, in their order, are the first with their keys."""
    key = keys[0] if len(keys) == 1 else _paired(keys[0], keys[1])
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


@tidy()
def _named(batches, shape: Shape):
    for batch in large(batches, "raw"):
        ids = np.array(batch["id"].to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        texts = batch["raw"].take(pa.array(order)).to_pylist()
        row, place, name, around = _sampled(texts, shape)
        document = ids[order][row] if len(row) else np.zeros(0, np.int64)
        kind = np.where(_first_of(name, around), SORT, REPEATS)
        # of the surroundings of one name, the first two are sorted; the name repeats, so the others are open
        firsts = np.flatnonzero(kind == SORT)
        by_name = firsts[np.argsort(name[firsts], kind="stable")]
        new = np.append(True, name[by_name][1:] != name[by_name][:-1]) if len(by_name) else np.zeros(0, bool)
        serial = np.arange(len(by_name)) - np.maximum.accumulate(np.where(new, np.arange(len(by_name)), 0)) if len(by_name) else new
        kind[by_name[serial >= 2]] = OPEN
        spread = _paired(document.astype("<u8"), place.astype("<u8"))
        yield _table(name=np.where(kind == SORT, name, spread), around=np.where(kind == SORT, around, 0).astype("<u8"), id=document, at=place * 4 + kind)


@tidy()
def _settled(batches):
    """(id, at): positions that repeat or are open, from rows sorted by name; a name's rows are seen together."""
    held: list[np.ndarray] = []

    def decide(part: np.ndarray) -> pa.RecordBatch:
        name, around, document, at = part
        new_name = np.append(True, name[1:] != name[:-1])
        new = new_name | np.append(True, around[1:] != around[:-1])
        group = np.cumsum(new_name) - 1
        several = (np.bincount(group, new) > 1)[group]
        kind = at % 4
        out = np.where(kind != SORT, kind, np.where(~new, REPEATS, np.where(several, OPEN, SORT)))
        kept = out != SORT
        return _table(id=document[kept], at=(at[kept] // 4) * 4 + out[kept])

    for batch in batches:
        part = np.array([batch[c].to_numpy() for c in ("name", "around", "id", "at")])
        if held:
            part = np.concatenate([*held, part], axis=1)
        if not part.shape[1]:
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if cut:
            yield decide(part[:, :cut])
        held = [part[:, cut:]]
    if held:
        yield decide(held[0])


#: What the rounds' rows hold: packed ranks and names of a bucket with their positions, or a run of starts known to repeat.
WINDOWS = "bucket long, names binary, ids binary, starts binary, id long, low long, high long"
_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_COLUMNS = [x.split()[0] for x in WINDOWS.split(", ")]


def _runs(document: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first start and last start of runs of neighbouring starts, of rows in order."""
    if not len(start):
        return document, start, start
    new = np.flatnonzero(np.append(True, (document[1:] != document[:-1]) | (start[1:] != start[:-1] + 1)))
    return document[new], start[new], start[np.append(new[1:], len(start)) - 1]


def _repeating(document: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of starts that repeat, as rows of WINDOWS."""
    order = np.lexsort((start, document))
    runs = _runs(document[order], start[order])
    return pa.RecordBatch.from_arrays([pa.nulls(len(runs[0]), k) for k in _KINDS[:4]] + [pa.array(x, pa.int64()) for x in runs], _COLUMNS)


def _dealt(names: np.ndarray, document: np.ndarray, start: np.ndarray, buckets: int):
    """Positions packed by bucket, as rows of WINDOWS. names: the rank and the names of the rests; the next sort's pair decides the bucket."""
    squeeze = zstandard.ZstdCompressor(level=1)
    key = names[:, 0] if names.shape[1] == 1 else _paired(names[:, 0], names[:, 1])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])) if len(by) else by
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(by))):
        own = by[a:b]
        rows.append((int(bucket[own[0]]), names[own].tobytes(), squeeze.compress(np.diff(document[own], prepend=0).tobytes()), squeeze.compress(start[own].astype("<i8").tobytes())))
    for a in range(0, len(rows), 500):
        part = list(zip(*rows[a : a + 500]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, _KINDS)] + [pa.nulls(len(part[0]), k) for k in _KINDS[4:]], _COLUMNS)


@tidy()
def _windows(batches, buckets: int, shape: Shape):
    """The windows around open positions: the first of a batch's equal ones; others are known to repeat.

    A window's names are that of its first bytes, as many as the first round ranks, and those of the rests that later rounds add.
    """
    widths = shape.widths
    for batch in large(batches, "packed", 6 << 20):
        ids = np.array(batch["id"].to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        packed, listed = batch["packed"].take(pa.array(order)), batch["marks"].take(pa.array(order))
        found = []
        for low in range(0, len(order), 256):
            texts = [zstandard.decompress(x) for x in packed[low : low + 256].to_pylist()]
            marks = [np.sort(np.array(x, np.int64)) for x in listed[low : low + 256].to_pylist()]
            for group in pieces(texts, shape):
                named = Named(group, shape)
                for piece, start in zip(group, named.starts):
                    open_at = marks[piece.row]
                    open_at = open_at[(open_at >= piece.begin) & (open_at < piece.end)]
                    if not len(open_at):
                        continue
                    at = open_at - piece.low + start
                    s = at[:, None] + np.arange(-shape.back, 1)
                    inside = (s >= start) & (s < len(named.least))
                    s_in = np.where(inside, s, 0)
                    holds = inside & named.valid[s_in] & (named.least[s_in] == named.gram[at][:, None])
                    s = np.unique(s_in[holds])
                    names = [named.named(s, widths[0])] + [named.named(s + wide - width, width) for width, wide in zip(widths, widths[1:])]
                    found.append((np.full(len(s), ids[order[low + piece.row]]), s - start + piece.low, np.column_stack(names)))
        if not found:
            continue
        document, start, names = (np.concatenate(x) for x in zip(*found))
        whole, other = names[:, 0], names[:, 0]
        for k in range(1, names.shape[1]):
            whole, other = _paired(whole, names[:, k]), _paired(names[:, k], other)
        first = _first_of(whole, other)
        yield _repeating(document[~first], start[~first])
        yield from _dealt(names[first], document[first], start[first], buckets)


@tidy()
def _ranked(batches, width: int, before: int | None, last: bool, buckets: int):
    """One round: the positions of a bucket, which come together, by rank and, after the first round, the name of what follows it.

    Equal pairs get a new rank. Positions of unique pairs leave; of the last round, those that repeat are given.
    width, before: columns of names, and how many of them the pair takes.
    """
    held: list[dict] = []
    here = None

    def decide():
        names = np.concatenate([np.frombuffer(x["names"], "<u8").reshape(-1, width) for x in held])
        document = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(x["ids"]), "<i8")) for x in held])
        start = np.concatenate([np.frombuffer(zstandard.decompress(x["starts"]), "<i8") for x in held])
        pair = [names[:, k] for k in range(before)]
        order = np.lexsort((start, document, *pair[::-1]))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in pair:
            new[1:] |= x[order][1:] != x[order][:-1]
        if last:
            yield _repeating(document[order][~new], start[order][~new])
            return
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        kept = order[shared]
        rank = (np.uint64(here) << np.uint64(32)) | group[shared].astype("<u8")
        yield from _dealt(np.column_stack([rank, names[kept][:, before:]]), document[kept], start[kept], buckets)

    for batch in batches:
        known = batch.filter(pc.is_null(batch["bucket"]))
        if known.num_rows:
            yield known
        for row in batch.filter(pc.is_valid(batch["bucket"])).select(["bucket", "names", "ids", "starts"]).to_pylist():
            if row["bucket"] != here and held:
                yield from decide()
                held.clear()
            here = row["bucket"]
            held.append(row)
    if held:
        yield from decide()


@tidy()
def _kept(batches):
    """The result of every document, from its bytes and the starts and ends of what repeats."""
    for batch in small(batches):
        out = []
        for raw, marks in zip(batch["packed"].to_pylist(), batch["marks"].to_pylist()):
            raw = zstandard.decompress(raw)
            low = np.maximum(np.array([x["low"] for x in marks or []], np.int64), 0)
            high = np.minimum(np.array([x["high"] for x in marks or []], np.int64), len(raw))
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            gone = np.cumsum(change)[:-1] > 0
            edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            left, p = hashlib.sha256(), 0
            for a, b in zip(begin.tolist(), end.tolist()):
                left.update(raw[p:a])
                p = b
            left.update(raw[p:])
            out.append((len(raw), int(gone.sum()), len(begin), left.hexdigest(), [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]))
        columns = list(zip(*out)) if out else [()] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(c, t) for c, t in zip(columns, types)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


@tidy()
def _packed(batches):
    """Texts travel compressed: they are sorted twice by document."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in small(batches):
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([squeeze.compress(x) for x in batch["raw"].to_pylist()], pa.binary())], ["id", "packed"])


def repeated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every document; removed: the maximal runs of bytes."""
    spark, shape = documents.sparkSession, Shape(length)
    long_texts(spark)
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    keyed, ids = own_keys(plain, "id", ["raw"], "repeats-rows")
    plain = keyed.select(F.col("key").alias("id"), "raw")
    # a shuffle of rows of the texts' size has parts of a bounded size; the sample is about twice as large
    size = plain.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART)
    packed = plain.mapInArrow(_packed, "id long, packed binary").repartition(parts, "id")
    pairs = plain.mapInArrow(lambda b: _named(b, shape), "name long, around long, id long, at long")
    ordered = pairs.repartition(2 * parts, "name").sortWithinPartitions("name", "around", "id", "at")
    settled = materialise(ordered.mapInArrow(_settled, "id long, at long"), "repeats-settled")
    is_open, place = F.col("at") % 4 == OPEN, F.shiftright("at", 2)
    # an open position has as many windows as it has starts before it, half of them its own
    buckets = max(64, settled.where(is_open).count() * (shape.back // 2 + 1) // BUCKET)
    open_docs = settled.where(is_open).repartition(parts, "id").groupBy("id").agg(F.collect_list(place).alias("marks"))
    windows = packed.join(open_docs, "id").mapInArrow(lambda b: _windows(b, buckets, shape), WINDOWS)
    rounds = len(shape.widths)
    for k in range(rounds):
        columns, pair, last = rounds - max(0, k - 1), 1 if k == 0 else 2, k == rounds - 1
        # runs that are known already have no bucket: a hash of their place spreads them
        dealt = windows.withColumn("key", F.coalesce("bucket", F.xxhash64("id", "low"))).repartition(parts, "key").sortWithinPartitions("key", "bucket").drop("key")
        windows = dealt.mapInArrow(lambda b, a=(columns, pair, last): _ranked(b, *a, buckets), WINDOWS)
        windows = materialise(windows.select("id", "low", "high") if last else windows, f"repeats-round-{k}")
    # in bytes: all windows of a run, or all that a sampled position's surroundings hold
    runs = windows.select("id", F.struct("low", (F.col("high") + length).alias("high")).alias("mark"))
    whole = settled.where(F.col("at") % 4 == REPEATS).select("id", F.struct((place - shape.back).alias("low"), (place + length).alias("high")).alias("mark"))
    by_document = runs.unionAll(whole).repartition(parts, "id").groupBy("id").agg(F.collect_list("mark").alias("marks"))
    span = "array<struct<start: long, end: long>>"
    result = packed.join(by_document, "id", "left").mapInArrow(_kept, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {span}")
    return result if ids is None else result.withColumnRenamed("id", "key").join(ids, "key").select("id", *result.columns[1:])
