"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a bag of trigrams of character classes (letter case, digit, white space, and each ASCII sign by itself) and
of letter pairs, damped and weighted by inverse document frequency, with two more terms for the shares of its lines that
repeat and of its words that equal the word before; every term that two texts of the sample hold counts. Truncated singular vectors of a bounded sample of labelled texts give the space; the sample's vectors and
labels are broadcast, and each document's exact cosine with every one of them is computed block by block. The k most
similar (with ties at the k-th) vote with the positive part of their similarity, raised to a power, times the number of
usable labels of its class that a voter stands for: the classes count by their shares of all usable labels.

Null and empty texts, and texts with no term of the space, get the share of label 1 in the weighted sample. Repeated rows get
the same score each; rows without an id are scored too. Very long texts are read whole, one at a time. An empty sample scores
every row 0.5, an empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import long_texts, materialise
from .toxicity import training_rows
from .workers import tidy

#: Character classes of UTF-8 bytes: lower, upper, digit, space, line end, bytes beyond ASCII, and each other sign.
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
for _n, _c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
    _CLASS[_c] = 6 + _n
_WIDTH = int(_CLASS.max()) + 1
_PAIR = np.full(256, 27, np.int64)
_PAIR[ord("a") : ord("z") + 1] = np.arange(26)
_PAIR[ord("A") : ord("Z") + 1] = np.arange(26)
_PAIR[128:] = 26
TERMS = _WIDTH**3 + 28 * 28 + 20


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and damped counts of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    c, p = _CLASS[raw], _PAIR[raw]
    at = np.concatenate([(c[:-2] * _WIDTH + c[1:-1]) * _WIDTH + c[2:], _WIDTH**3 + p[:-1] * 28 + p[1:]])
    counts = np.bincount(at, minlength=0)
    found = np.flatnonzero(counts)
    lines = [x for x in text.split("\n") if x.strip()]
    words = text.split()
    shares = (1 - len(set(lines)) / max(1, len(lines)), sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1))
    more = [_WIDTH**3 + 784 + 10 * i + min(9, int(10 * x)) for i, x in enumerate(shares)]
    return np.append(found, more), np.append(np.sqrt(counts[found] / len(raw)), [0.5, 0.5])


@dataclass(frozen=True)
class Neighbours:
    """space: terms by dimensions, weighted; vectors: unit rows of the sample; labels: 0 or 1 of each; weights: what its vote counts."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int = 15
    power: float = 8.0
    weights: np.ndarray | float = 1.0

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.space.shape[1]))
        for row, text in zip(out, texts):
            at, values = terms(text)
            if len(at):
                row[:] = values @ self.space[at]
                norm = np.sqrt(row @ row)
                if norm > 0:
                    row /= norm
        return out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        score = np.full(len(vectors), self.prior)
        k = min(self.k, len(self.labels))
        if not k:
            return score
        near = vectors @ self.vectors.T
        least = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
        weight = np.where(near >= least - 1e-12, np.maximum(near, 0) ** self.power, 0) * self.weights
        total = weight.sum(axis=1)
        usable = (total > 1e-12) & vectors.any(axis=1)
        score[usable] = (weight @ self.labels)[usable] / total[usable]
        return np.clip(score, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", bound: int = 2048, dimensions: int = 48) -> Neighbours:
    """The space and the voters, from `bound` labelled rows of each class at most: the documented sample of a classifier."""
    long_texts(documents.sparkSession)
    rows = materialise(training_rows(documents, labels, label, usable, bound), "quality-rows")

    def termed(batches):
        for batch in batches:
            found = [terms(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary()), batch["label"].cast(pa.int64()), batch["weight"]], ["at", "value", "label", "weight"])

    # the sample is bounded, and so is what the driver gets: a few hundred terms of each text
    got = rows.mapInArrow(termed, "at binary, value binary, label long, weight double").orderBy("label", "at", "value", "weight").collect()
    counts = np.array([r["label"] for r in got], float)
    if not len(got):
        return Neighbours(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    weights = np.array([r["weight"] for r in got])
    weights /= weights.mean()
    used = [(np.frombuffer(r["at"], np.int64), np.frombuffer(r["value"], float)) for r in got]
    frequency = np.zeros(TERMS)
    for at, _ in used:
        frequency[at] += 1
    kept = np.flatnonzero(frequency >= 2)
    idf = np.log((1 + len(used)) / (1 + frequency[kept])) + 0.1
    place = np.full(TERMS, -1)
    place[kept] = np.arange(len(kept))

    def columns(begin: int, end: int) -> np.ndarray:
        """The weighted terms of every text, as many columns as are asked for."""
        part = np.zeros((len(used), end - begin), np.float32)
        for row, (at, values) in zip(part, used):
            own = place[at]
            mine = (own >= begin) & (own < end)
            row[own[mine] - begin] = values[mine]
        return part * idf[begin:end].astype(np.float32)

    # the smaller of the two products has the same singular vectors; neither outgrows the bounded sample
    step = max(1, len(used))
    cuts = [(a, min(a + step, len(kept))) for a in range(0, len(kept), step)]
    if len(cuts) == 1:
        matrix = columns(*cuts[0])
        basis = _leading((matrix.T @ matrix).astype(float), dimensions)
    else:
        gram = np.zeros((len(used), len(used)), np.float32)
        for cut in cuts:
            part = columns(*cut)
            gram += part @ part.T
        sides = _leading(gram.astype(float), dimensions)
        basis = np.concatenate([columns(*cut).T @ sides for cut in cuts] or [np.zeros((0, sides.shape[1]))])
        size = np.linalg.norm(basis, axis=0)
        basis = basis / np.where(size > 0, size, 1)
    if len(kept):
        basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1, 1)
    space = np.zeros((TERMS, basis.shape[1]), np.float32)
    space[kept] = (idf[:, None] * basis).astype(np.float32)
    vectors = np.zeros((len(used), basis.shape[1]))
    for begin, end in cuts:
        vectors += columns(begin, end).astype(float) @ basis[begin:end]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Neighbours(space, vectors / np.where(norm > 0, norm, 1), counts, float((weights * counts).mean()), weights=weights)


def _leading(product: np.ndarray, dimensions: int) -> np.ndarray:
    """The eigenvectors of the largest eigenvalues, as columns."""
    values, vectors = np.linalg.eigh(product)
    return vectors[:, np.argsort(-values)[: min(dimensions, len(values))]]


def score(documents: DataFrame, model: Neighbours, *, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """(id, score) of every document."""
    kept = np.flatnonzero(np.abs(model.space).sum(axis=1) > 0)
    # what is broadcast has a fixed bound: TERMS terms and 2 * bound voters, by dimensions (48 floats each, 21 MB at most)
    shared = documents.sparkSession.sparkContext.broadcast((kept, model.space[kept], model.space.shape, model.vectors, model.labels, model.prior, model.k, model.power, model.weights))
    held: list[Neighbours] = []

    @tidy()
    def scored(batches):
        if not held:
            at, values, shape, *rest = shared.value
            space = np.zeros(shape, np.float32)
            space[at] = values
            held.append(Neighbours(space, *rest))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                votes = held[0].vote(held[0].project(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.float64())], ["id", "score"])

    plain = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(scored, f"id {plain.schema['id'].dataType.simpleString()}, score double")
