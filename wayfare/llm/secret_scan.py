"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger holds, for each scanned blob and
rule version, its spans; only pairs that it lacks are scanned, each blob once however many paths hold it, and findings
are joined back to every path. Spans are (kind, start, end) in code points, end exclusive, sorted by start and then by
the order of KINDS.

Null texts count as empty; a blob without findings has a ledger row with no spans. Paths without an id are kept.
Repeated rows each get their own result row. A ledger that a retried append wrote twice gives the same result. Very long
texts are scanned whole, a few texts in memory at a time; a private key without its end line reaches as far as its
lines of code letters. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import long_texts, materialise
from .workers import small, tidy

#: The patterns of the three base kinds, as the contract gives them, and how long their matches must be.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Further kinds: a substring that a match holds, and the pattern.
MORE = {
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\s-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{24,})*)")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "git": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abposr]-[A-Za-z0-9-]{10,}")),
    "bearer": ("earer ", re.compile(r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}=*")),
    "url": ("://", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", re.ASCII)),
}
KINDS = ("assign", "access", "hex", *MORE)
RULES_VERSION = hashlib.sha256(repr([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, sorted((k, s, p.pattern) for k, (s, p) in MORE.items())]).encode()).hexdigest()[:16]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.StringType()), T.StructField("spans", SPANS)])
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, in order."""
    found = []
    if ("=" in text or ":" in text) and any(x in low for low in (text.lower(),) for x in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # of every eighth bytes, two that follow each other lie in any run of sixteen
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) >= 16:
        probe = _HEX_BYTE[raw[7::8]]
        if (probe[1:] & probe[:-1]).any():
            found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, (holds, pattern) in MORE.items():
        if holds in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@tidy()
def _scanned(batches):
    for batch in small(batches):
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch["text"].to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(spans, kind)], ["blob", "spans"])


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, *, path_col: str, text_col: str, ledger: str | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """(path, blob, spans) for every version; scans only blobs that the ledger at that folder lacks for these rules.

    ledger: a Parquet folder of LEDGER rows, which is read and appended to; None starts an empty one.
    """
    spark: SparkSession = versions.sparkSession
    long_texts(spark)
    paths = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", content_address(F.col("text")))
    # one path to read each blob from, by narrow rows alone
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    old = None
    if ledger:
        try:
            old = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == rules).select("blob", "spans")
        except Exception as error:  # the folder does not exist yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if old is not None:
        blobs = blobs.join(old.select("blob"), "blob", "left_anti")
    blobs = materialise(blobs, "unseen-blobs")
    same = (paths["blob"] == blobs["blob"]) & paths["path"].eqNullSafe(blobs["path"])
    texts = paths.join(blobs, same, "left_semi").select("blob", "text")
    new = texts.mapInArrow(_scanned, T.StructType([LEDGER["blob"], LEDGER["spans"]])).dropDuplicates(["blob"])
    if ledger:
        new.withColumn("rules", F.lit(rules)).select(*LEDGER.names).write.mode("append").parquet(ledger)
        found = spark.read.schema(LEDGER).parquet(ledger).where((F.col("rules") == rules) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    else:
        found = materialise(new, "blob-findings").where("size(spans) > 0")
    # most blobs have no span: only those that have one are joined back
    return paths.select("path", "blob").join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr("array()").cast(SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are replaced as one."""

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        out = []
        for text, own in zip(texts, found):
            if text is not None and own is not None and len(own):
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return cut(text, spans)
