"""Token ids in directly addressable files.

A file holds the ids of a run of documents. Ids are split into chunks of eight bits: level 0 has the low chunk of every
id, level k + 1 the next chunk of those ids whose bit in level k's continuation bitmap is set. A rank directory counts
the bits set before every 512th, so that the place of any id at every level, and so the id, is found by a few reads at
known offsets; no block is decoded. A file is written whole, under the name of the task attempt that wrote it; only
files in the manifest count, so lost and repeated attempts do no harm.

Layout, little-endian: magic, number of ids, of documents and of levels (int64 each), then for each level its number of
chunks (int64); then document ids (int64), null flags (uint8) and ends (int64); then for each level its chunks, bitmap and
directory (uint64). Sections begin at multiples of eight.

A task writes files of a bounded number of ids, and a reader decodes runs of documents, found through the rank directories,
so memory follows neither the partitions nor the files; a very long document is one run.

Documents are ordered by id, then text; null ids come first. Null and empty texts have the end id alone. Repeated rows
are repeated documents. An empty table gives no files. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import long_texts, materialise, shared_dir
from .workers import tidy

MAGIC, BLOCK = int.from_bytes(b"DACTOK01", "little"), 512
#: Ids after which a file is closed, and ids that are decoded together.
FILE_IDS, RUN_IDS = 8 << 20, 1 << 20


def _pad(n: int) -> int:
    return -n % 8


def encode(document_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file, in order."""
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    chunks = [np.ascontiguousarray(every[:, k]) for k in range(4)]
    while len(chunks) > 1 and not chunks[-1].any():
        chunks.pop()
    while chunks:
        more = np.zeros(len(chunks[0]), bool)
        for later in chunks[1:]:
            more |= later != 0
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u8") if len(more) else np.zeros(0, "<u8")
        levels.append((chunks[0], np.packbits(more, bitorder="little"), np.append(np.zeros(1, "<u8"), np.cumsum(counts)).astype("<u8")))
        chunks = [c[more] for c in chunks[1:]]
    sections = [np.array([x or 0 for x in document_ids], "<i8"), np.array([x is None for x in document_ids], "u1"), ends.astype("<i8")]
    for level in levels:
        sections += level
    out = [np.array([MAGIC, len(ids), len(document_ids), len(levels), *(len(x[0]) for x in levels)], "<i8").tobytes()]
    for section in sections:
        raw = section.tobytes()
        out += [raw, b"\0" * _pad(len(raw))]
    return out


class TokenFile:
    """Reads any id, range of ids or document of a file; source: a seekable pyarrow file."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        magic, self.n_ids, self.n_documents, n_levels = self._at(0, "<i8", 4)
        if magic != MAGIC:
            raise ValueError("not a token file")
        counts = self._at(32, "<i8", int(n_levels))
        at = 32 + 8 * int(n_levels)
        self.documents = at
        for size in (8, 1, 8):
            at += size * int(self.n_documents) + _pad(size * int(self.n_documents))
        self.levels = []
        for n in map(int, counts):
            bits = at + n + _pad(n)
            size = (n + 7) // 8
            directory = bits + size + _pad(size)
            self.levels.append((at, bits, directory))
            at = directory + 8 * ((n + BLOCK - 1) // BLOCK + 1)

    def _at(self, offset: int, kind: str, n: int) -> np.ndarray:
        self.source.seek(offset)
        return np.frombuffer(self.source.read(n * np.dtype(kind).itemsize), kind)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, null flags and ends."""
        n, at, out = int(self.n_documents), self.documents, []
        for kind in ("<i8", "u1", "<i8"):
            out.append(self._at(at, kind, n))
            size = n * np.dtype(kind).itemsize
            at += size + _pad(size)
        return out[0], out[1].astype(bool), out[2]

    def _rank(self, level: int, i: int) -> int:
        """Bits set before the i-th of a level."""
        _, bits, directory = self.levels[level]
        block = i // BLOCK
        before = int(self._at(directory + 8 * block, "<u8", 1)[0])
        part = np.unpackbits(self._at(bits + block * BLOCK // 8, "u1", (i - block * BLOCK + 7) // 8), bitorder="little")
        return before + int(part[: i - block * BLOCK].sum())

    def range(self, begin: int, end: int, level: int = 0) -> np.ndarray:
        """The ids from begin to end (exclusive)."""
        if begin >= end:
            return np.zeros(0, "<u4")
        chunks, bits, _ = self.levels[level]
        out = self._at(chunks + begin, "u1", end - begin).astype("<u4")
        if level + 1 < len(self.levels):
            first = begin // 8
            more = np.unpackbits(self._at(bits + first, "u1", (end + 7) // 8 - first), bitorder="little")[begin - first * 8 : end - first * 8].astype(bool)
            at = self._rank(level, begin)
            out[more] |= self.range(at, at + int(more.sum()), level + 1) << 8
        return out

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        return int(self.range(i, i + 1)[0])


def open_uri(uri: str) -> pa.NativeFile:
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def write_whole(folder: str, name: str, parts: Iterable[bytes]) -> str:
    """A new file of the folder, visible under its name when it is whole."""
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/.{name}") as out:
        for part in parts:
            out.write(part)
    files.move(f"{path}/.{name}", f"{path}/{name}")
    return f"{folder}/{name}"


@tidy()
def _written(batches, folder: str, tokenizer: str, end_id: int):
    from .tokenizing import encoder

    own, parts, held, serial, end = [], [], 0, 0, np.array([end_id], "<u4")
    context = TaskContext.get()

    def closed() -> pa.RecordBatch:
        nonlocal held, serial
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{serial:04d}.dac"
        ends = np.cumsum([len(x) for x in parts])
        path = write_whole(folder, name, encode(own, ends, np.concatenate(parts)))
        row = {"part": [context.partitionId()], "serial": [serial], "path": [path], "n_documents": [len(own)], "n_tokens": [int(ends[-1])]}
        own.clear(), parts.clear()
        held, serial = 0, serial + 1
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own += part["id"].to_pylist()
            for ids in encoder(tokenizer).encode(part["text"].to_pylist()):
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
            if held >= FILE_IDS:
                yield closed()
    if own:
        yield closed()


def write(documents: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending order of document; gives the manifest (part, serial, path, n_documents, n_tokens, base).

    base: the number of ids in all files before. The manifest has a row a file.
    """
    spark = documents.sparkSession
    long_texts(spark)
    folder = folder or shared_dir(spark, "tokens")
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(lambda b: _written(b, folder, tokenizer, end_id), "part long, serial long, path string, n_documents long, n_tokens long")
    files = materialise(files, "token-manifest")
    before = Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


@tidy()
def _read(batches):
    for batch in batches:
        for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
            with open_uri(path) as source:
                found = TokenFile(source)
                own, null, ends = found.table()
                begin = np.append(0, ends[:-1])
                at = 0
                while at < len(own):
                    # documents whose ids are decoded together
                    to = max(at + 1, int(np.searchsorted(ends, begin[at] + RUN_IDS, side="right")))
                    ids = found.range(int(begin[at]), int(ends[to - 1]))
                    digests = [zlib.crc32(ids[a:b]) for a, b in zip((begin[at:to] - begin[at]).tolist(), (ends[at:to] - begin[at]).tolist())]
                    columns = [pa.array(own[at:to], mask=null[at:to]), pa.array(begin[at:to] + base), pa.array((ends - begin)[at:to]), pa.array(digests, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = max(1, manifest.count())
    dealt = manifest.select("path", "base").repartition(files, "path")
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
