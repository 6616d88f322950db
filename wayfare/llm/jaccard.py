"""N-gram Jaccard join: MinHash banding, then verification on the full sets of word n-grams.

Words are runs of letters, digits and underscores, in lower case; a document of fewer than n words has one n-gram of
all its words. Documents with equal n-gram sets are represented by the one with the smallest id; documents without words
are equal when their texts are (null counts as empty). Representatives are linked when the Jaccard similarity of their sets is
at least the threshold. `bands` bands of `rows` rows miss a pair at the threshold with probability
(1 - threshold ** rows) ** bands, 7e-5 with the defaults, and more similar pairs less often.

Every row counts as a document: rows that share an id, and rows without one, are compared each with its own text; a class
in which no row has an id has null for its number. Ties go to the smallest id. Very long texts are worked on whole, their
signatures block by block. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, few, long_texts, materialise, own_keys, pair_blocks
from .workers import small, tidy

_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "<u8")
#: Members of a chunk of a band bucket: a task compares two chunks at a time.
CHUNK = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to 64-bit hash, computed once a worker; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct 64-bit hashes of the n-grams of words, ascending."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, "<u8")
    h = np.fromiter(map(_HASHES.__getitem__, words), "<u8", len(words))
    size = min(n, len(h))
    total = np.zeros(len(h) - size + 1, "<u8")
    for i in range(size):
        total = _mixed(total * _ODD[i % 5] + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def signature(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest hash of the set for each seed; long sets go block by block."""
    least = np.full(len(seeds), np.iinfo("u8").max, "<u8")
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        least = np.minimum(least, (((part[:, None] ^ seeds) * _ODD[0]) ^ ((part[:, None] ^ seeds) >> np.uint64(32))).min(axis=0))
    return least


def _digest(found: np.ndarray, text: str | None) -> bytes:
    return xxhash.xxh128_digest(found.tobytes() if len(found) else b"\0" + (text or "").encode("utf-8", "surrogatepass"))


@tidy(_HASHES.clear)
def _digested(batches, n: int, bands: int, rows: int):
    """(id, digest, bands): a digest of the set, and one hash for each band; no bands where the set is empty."""
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype="<u8") * _ODD[0])
    for batch in small(batches):
        digests, banded = [], []
        for text in batch["text"].to_pylist():
            found = shingles(text, n)
            digests.append(_digest(found, text))
            least = signature(found, seeds).reshape(bands, rows) if len(found) else None
            if least is not None:
                total = np.zeros(bands, "<u8")
                for i in range(rows):
                    total = _mixed(total * _ODD[i % 5] + least[:, i])
                banded.append(_mixed(total + np.arange(bands, dtype="<u8")).view("<i8"))
            else:
                banded.append(None)
        values = pa.array([None if x is None else x.tolist() for x in banded], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(digests, pa.binary()), values], ["id", "digest", "bands"])


@tidy(_HASHES.clear)
def _sets(batches, n: int):
    for batch in small(batches):
        texts = batch["text"].to_pylist()
        found = [shingles(t, n) for t in texts]
        digests = pa.array(map(_digest, found, texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch["id"], digests, pa.array([x.tobytes() for x in found], pa.binary())], ["id", "digest", "grams"])


def links_in_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of the sets whose Jaccard similarity is at least the threshold, exactly.

    Only n-grams that two members or more hold can be shared; products of their incidence rows count them.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, grams = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.append(True, grams[1:] != grams[:-1])
    term = np.cumsum(new) - 1
    often = np.bincount(term) >= 2
    kept = often[term]
    column, owner = (np.cumsum(often) - 1)[term[kept]], owner[kept]
    shared = np.zeros((len(left), len(right)), np.float32)
    width, place = 4096, np.full(len(sets), -1)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part[left] @ part[right].T
    place[left] = np.arange(len(left))
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    i, j = np.nonzero((shared >= threshold * union - 1e-6) & (shared > 0))
    exact = shared[i, j] / union[i, j].astype(float) >= threshold - 1e-12
    return left[i[exact]], right[j[exact]]


def _linked(frame, threshold: float):
    """Counts of links by member, and edges that join the same members: one to the smallest partner is kept for each."""
    import pandas as pd

    frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(x, "<u8") for x in frame["grams"]]
    i, j = int(frame["chunk_i"].iloc[0]), int(frame["chunk_j"].iloc[0])
    chunk = frame["chunk"].to_numpy()
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    out = pd.DataFrame({"rep": [], "partners": [], "weight": [], "least": []})
    if len(left) and len(right) and len(frame) > 1:
        a, b = links_in_block(sets, left, right, threshold)
        if i == j:
            a, b = a[a < b], b[a < b]
        if len(a):
            # a pair counts in the first bucket only that both members share
            width = max(map(len, frame["buckets"]))
            own = np.stack([np.pad(np.asarray(x, np.int64), (0, width - len(x)), constant_values=-1) for x in frame["buckets"]])
            here, step = int(frame["bucket"].iloc[0]), 200_000
            first = np.ones(len(a), bool)
            for at in range(0, len(a), step):
                x, y = own[a[at : at + step]], own[b[at : at + step]]
                same = np.where((x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0), x, np.iinfo(np.int64).max).min(axis=1)
                first[at : at + step] = same == here
            a, b = a[first], b[first]
            n, rep, weight = len(frame), frame["rep"].to_numpy(), frame["members"].to_numpy()
            count, total = np.bincount(a, minlength=n) + np.bincount(b, minlength=n), np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            # a spanning forest of the links, by repeated minima
            root = np.arange(n)
            while True:
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            has = np.flatnonzero(count)
            out = pd.DataFrame({"rep": rep[has], "partners": count[has], "weight": total[has], "least": rep[root[has]]})
    return out.astype({"rep": "int64", "partners": "int64", "weight": "int64", "least": "int64"})


def similar(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, bands: int = 18, rows: int = 4) -> DataFrame:
    """(id, class_id, n_links, set_id, set_size), one row a document.

    class_id: the smallest id that links reach, so that near copies share it. n_links: other documents that it is linked
    to, those with an equal set included. set_id: the smallest id with the same set. Near copies are verified block by block of their bucket
    and only counted, so no table of all pairs arises; pairs that meet in several buckets count in the first only.
    """
    long_texts(documents.sparkSession)
    plain = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed, names = own_keys(plain, "id", ["text"], "jaccard-rows")
    plain = keyed.select(F.col("key").alias("id"), "text")
    digested = plain.mapInArrow(lambda b: _digested(b, n, bands, rows), "id long, digest binary, bands array<long>")
    digested = materialise(digested, "jaccard-digests")
    one = digested.select("id", "digest")
    classes = one.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    membership = materialise(one.join(classes, "digest").select("id", "rep", "members", "digest"), "jaccard-members")
    reps = membership.where("id = rep").select("id", "digest", "members")
    banded = digested.join(reps, ["id", "digest"], "left_semi").where("bands is not null").select(F.col("id").alias("rep"), F.posexplode("bands").alias("band", "value"))
    band_rows = banded.distinct().select("rep", F.expr("shiftrightunsigned(xxhash64(band, value), 1)").alias("bucket"))
    # a bucket's members are told by their number and two sums of hashes: of buckets with the same members one is enough
    sums = [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(3))).alias("y")]
    buckets = band_rows.groupBy("bucket").agg(*sums).where("size > 1").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    member = materialise(band_rows.join(buckets, "bucket", "left_semi"), "jaccard-buckets")
    own = materialise(member.groupBy(F.col("rep").alias("id")).agg(F.array_sort(F.collect_set("bucket")).alias("buckets")).join(reps, "id"), "jaccard-active")
    texts = plain.join(few(own.select("id")), "id", "left_semi")
    sets = texts.mapInArrow(lambda b: _sets(b, n), "id long, digest binary, grams binary").join(own, ["id", "digest"])
    known = sets.select(F.col("id").alias("rep"), "grams", "buckets", "members")
    dealt = pair_blocks(member, ["bucket"], "rep", CHUNK).join(known, "rep")
    out = "rep long, partners long, weight long, least long"
    found = materialise(dealt.groupBy("bucket", "chunk_i", "chunk_j").applyInPandas(lambda f: _linked(f, threshold), out), "jaccard-links")
    near = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "jaccard").select(F.col("v").alias("rep"), F.col("component").alias("component_id"))
    counted = found.groupBy("rep").agg(F.sum("weight").alias("weight"))
    out = (
        membership.join(counted, "rep", "left").join(near, "rep", "left")
        .select(
            "id", F.coalesce("component_id", "rep").alias("class_id"),
            (F.col("members") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
            F.col("rep").alias("set_id"), F.col("members").alias("set_size"),
        )
    )
    return out if names is None else _named(out, names)


def _named(out: DataFrame, names: DataFrame) -> DataFrame:
    """The rows' own keys replaced by their ids."""
    for column in ("id", "class_id", "set_id"):
        out = out.withColumnRenamed(column, "key").join(names.withColumnRenamed("id", column), "key").drop("key")
    return out.select("id", "class_id", "n_links", "set_id", "set_size")
