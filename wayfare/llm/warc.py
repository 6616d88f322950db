"""WARC archives: deduplicated records, and a normaliser of files that are one gzip stream.

Writing gives, for each page, a response record or a revisit record without payload that refers to the response. The
archives are written as plain gzip, one stream a file, as many tools do; the normaliser then inflates each file's stream
once, from beginning to end in bounded memory, rewrites every record as a gzip member of its own, and writes a sidecar
index (page, type, offset, length) beside it, through which a reader gets any record by one seek.

Of pages with equal payloads of at least `least` bytes the smallest page id is the response. Null payloads are empty.
Rows without a page id, and repeated ids, get records of their own (null ids are never the response of others); a
repeated id with the same payload is response in each row. Long payloads are records like others, held one at a time by a
task, and close their file. Ids of any type come back as text, null as null. Empty tables give no archives. Further columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import long_texts, materialise, shared_dir
from .token_files import open_uri

CRLF = b"\r\n"
INDEX = "path string, page_id string, type string, offset long, length long, head long"
#: Bytes of payloads after which a file is closed.
FILE_BYTES = 256 << 20


#: The record id of a row without a page id.
NO_PAGE = "<urn:no-page>"


def _page(record_id: str) -> str | None:
    return None if record_id == NO_PAGE else record_id[10:-1]


def record(page_id: object, url: str | None, kind: str, digest: str, size: int, refers_to: object, payload: bytes) -> bytes:
    """The bytes of one record, up to and with the two empty lines at its end."""
    clean = "".join(c for c in url or "urn:none" if c > " ")
    own = NO_PAGE if page_id is None else f"<urn:page:{page_id}>"
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {own}".encode(), f"WARC-Target-URI: {clean}".encode("utf-8", "surrogatepass"), b"WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha256:{digest}".encode(), f"X-Payload-Length: {size}".encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    return CRLF.join(head) + CRLF + CRLF + payload + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and content of one record."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


class GzipFiles:
    """A file that is open for writing, visible under its name once it is closed."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(path, recursive=True)
        self.uri, self.hidden, self.path = f"{folder}/{name}", f"{path}/.{name}", f"{path}/{name}"
        self.out, self.at = self.files.open_output_stream(self.hidden, compression=None), 0

    def write(self, raw: bytes) -> int:
        before = self.at
        self.out.write(raw)
        self.at += len(raw)
        return before

    def close(self) -> str:
        self.out.close()
        self.files.move(self.hidden, self.path)
        return self.uri


def _name(serial: int) -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}-{serial:04d}.warc.gz"


def _monolithic(batches, folder: str):
    """Writes the rows' records, each file one gzip stream; gives the paths."""
    file = stream = None
    serial, held, paths = 0, 0, []

    def closed() -> None:
        nonlocal file
        file.write(stream.flush())
        paths.append(file.close())
        file = None

    for batch in batches:
        for row in batch.to_pylist():
            if file is None:
                file, stream, held, serial = GzipFiles(folder, _name(serial)), zlib.compressobj(6, zlib.DEFLATED, 31), 0, serial + 1
            revisit = row["refers_to"] is not None
            payload = (row["html"] or "").encode("utf-8", "surrogatepass")
            raw = record(row["page_id"], row["url"], "revisit" if revisit else "response", row["digest"], len(payload), row["refers_to"], b"" if revisit else payload)
            file.write(stream.compress(raw))
            held += len(raw)
            if held >= FILE_BYTES:
                closed()
    if file is not None:
        closed()
    if paths:
        yield pa.RecordBatch.from_pydict({"path": paths})


def records_of(source: pa.NativeFile, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, of one member or many, inflated once and in order."""
    inflate, held, at, raw, ended = zlib.decompressobj(31), bytearray(), 0, b"", False
    while not ended:
        raw = raw or source.read(step)
        ended = not raw
        # a bounded part at a time, however far the stream inflates
        held += inflate.flush() if ended else inflate.decompress(raw, 4 << 20)
        if inflate.eof:
            raw, inflate = inflate.unused_data, zlib.decompressobj(31)
        else:
            raw = inflate.unconsumed_tail
        while True:
            end = held.find(CRLF + CRLF, at)
            if end < 0:
                break
            head = held[at:end].lower()
            length = int(head[head.index(b"\r\ncontent-length:") + 17 :].partition(CRLF)[0])
            stop = end + 4 + length + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
        at = 0
    if held.strip():
        raise ValueError("the file ends inside a record")


def _normalised(batches, folder: str):
    """Rewrites every file with a member for each record, and writes its sidecar; gives the index."""
    import json

    serial = 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            file, rows = GzipFiles(folder, _name(serial)), []
            serial += 1
            with open_uri(path) as source:
                for raw in records_of(source):
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = deflate.compress(raw) + deflate.flush()
                    headers, _ = parse(raw)
                    rows.append((_page(headers["warc-record-id"]), headers["warc-type"], file.write(member), len(member), len(raw)))
            uri = file.close()
            side = GzipFiles(folder, uri.rpartition("/")[2].replace(".warc.gz", ".index.jsonl"))
            for page_id, kind, offset, length, _ in rows:
                side.write(json.dumps({"page_id": page_id, "type": kind, "offset": offset, "length": length}).encode() + b"\n")
            side.close()
            for at in range(0, len(rows), 10_000):
                part = list(zip(*rows[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part[0])), *[pa.array(x, t) for x, t in zip(part, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]], ["path", "page_id", "type", "offset", "length", "head"])


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, folder: str | None = None) -> DataFrame:
    """Writes one-stream archives of all pages; gives their paths."""
    long_texts(pages.sparkSession)
    folder = folder or shared_dir(pages.sparkSession, "warc-plain")
    html = F.coalesce(F.col(payload_col), F.lit(""))
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    size = F.octet_length("html")
    # groups of equal payloads, by digests alone; a group of one needs no reference
    groups = plain.where(size >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "warc-groups")
    refers = F.when((size >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to")
    dealt = plain.join(groups, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers)
    return materialise(dealt.mapInArrow(lambda b: _monolithic(b, folder), "path string"), "warc-files")


def normalise(files: DataFrame, folder: str | None = None) -> DataFrame:
    """One member for each record, and sidecar indexes; gives the whole index (path, page_id, type, offset, length, head).

    head: the record's length when inflated. A file is a task's whole work; archives are written with a bounded size.
    """
    folder = folder or shared_dir(files.sparkSession, "warc")
    dealt = files.select("path").repartition(max(1, files.count()), "path")
    return materialise(dealt.mapInArrow(lambda b: _normalised(b, folder), INDEX), "warc-index")


def _fetched(batches):
    for batch in batches:
        rows, source, opened = [], None, ""
        for path, offset, length in zip(*(batch[c].to_pylist() for c in ("path", "offset", "length"))):
            if path != opened:
                source, opened = open_uri(path), path
            source.seek(offset)
            headers, content = parse(zlib.decompress(source.read(length), 31))
            revisit = headers["warc-type"] == "revisit"
            size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].partition(":")[2]
            if not revisit and (len(content) != size or hashlib.sha256(content).hexdigest() != digest):
                raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
            refers = headers["warc-refers-to"][10:-1] if revisit else None
            rows.append((_page(headers["warc-record-id"]), size, digest, headers["warc-type"], refers))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by seeks; ids are strings."""
    return index.mapInArrow(_fetched, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
