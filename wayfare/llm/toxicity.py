"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes homoglyphs, digit and sign substitutions and case; anything but letters and digits is a boundary. A
pattern is a whole word (" word ") or the beginning of a word (" wor"), with a learned weight; an exception phrase
(" word next ") cancels the patterns that begin inside it. Of the patterns that begin at one word the heaviest counts.
The score is a logistic function of the summed weight, normalised by length, and of the heaviest weight.

Null and empty texts have no hits and get the score of a document without hits. Repeated rows get the same score each;
rows without an id are scored too. Very long texts are folded whole, one at a time. A training set without rows of both classes
gives an empty lexicon and a score of next to 0 (1e-13) for every row, an empty table an empty result. Other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import small, tidy

#: Look-alike letters of other scripts, and digits and signs written for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһӏкмтвнгαοιυνκρτ",
    "aeopcyxijsdhlkmtbhraoiuvkpt",
)
DIGITS = str.maketrans("0134578@$", "oieastbas")
_MIXED = re.compile(r"[^\W\d_]*[0134578@$]+(?=[^\W\d_])[\w@$]*|[^\W\d_]+[0134578]+\b")
_GAPS = re.compile(r"[\W_]+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def fold(text: str | None) -> str:
    """" word word " in folded letters, one space at every boundary."""
    text = (text or "").lower()
    if _NON_ASCII.search(text):
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if any("Ͱ" <= c <= "ԯ" for c in set(text)):
            text = text.translate(HOMOGLYPHS)
    text = _MIXED.sub(lambda m: m[0].translate(DIGITS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """weights: pattern to log odds. exceptions: phrases. model: intercept and factors of the three measures of a text."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    model: tuple[float, float, float, float]

    def automaton(self):
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def measures(folded: str, automaton) -> tuple[float, float, float]:
    """Summed weight by the square root of the number of words, heaviest weight, and the logarithm of hits by 100 words."""
    heaviest: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            begin = end - size + 1
            if weight is None:
                spared.append((begin, end))
            elif weight > heaviest.get(begin, 0.0):
                heaviest[begin] = weight
    for begin, end in spared:
        for at in [x for x in heaviest if begin <= x < end - 1]:
            del heaviest[at]
    words = max(1, folded.count(" ") - 1)
    total = sum(sorted(heaviest.values()))
    return total / math.sqrt(words), max(heaviest.values(), default=0.0), math.log1p(100.0 * len(heaviest) / words)


def _scores(texts: list[str | None], lexicon: Lexicon, automaton) -> list[float]:
    b, *w = lexicon.model
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, measures(fold(t), automaton))))))) for t in texts]


def score(text: Column, lexicon: Lexicon) -> Column:
    """The probability of toxic, from the whole text."""
    kept: list = []

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(lexicon.automaton())
        found: list[float] = []
        for at in range(0, len(texts), 256):
            found += _scores(texts[at : at + 256].to_pylist(), lexicon, kept[0])
        return pa.array(found, pa.float64())

    return scored(text)


#: Rows of which a task holds the features at a time.
ROWS = 128
_COUNTED = "feature string, part long, toxic long, other long"


@tidy()
def _features(batches):
    """(feature, part, toxic documents, other documents): each word and word beginning once a document."""
    for batch in small(batches, ROWS):
        rows = []
        for text, part, toxic in zip(batch["text"].to_pylist(), batch["part"].to_pylist(), batch["toxic"].to_pylist()):
            own = set()
            for word in set(fold(text).split()):
                own.add(f" {word} ")
                own.update(f" {word[:n]}" for n in range(4, min(9, len(word))))
            rows.append((own, part, toxic))
        yield _counts(rows)


@tidy()
def _phrases(batches, words: frozenset[str]):
    """The same of phrases: each lexicon word with the word after it."""
    for batch in small(batches, ROWS):
        rows = []
        for text, part, toxic in zip(batch["text"].to_pylist(), batch["part"].to_pylist(), batch["toxic"].to_pylist()):
            found = fold(text).split()
            rows.append(({f" {a} {b} " for a, b in zip(found, found[1:]) if a in words}, part, toxic))
        yield _counts(rows)


def _counts(rows: list[tuple[set[str], int, int]]) -> pa.RecordBatch:
    found: dict[tuple[str, int], list[int]] = {}
    for own, part, toxic in rows:
        for feature in own:
            found.setdefault((feature, part), [0, 0])[0 if toxic else 1] += 1
    columns = [[k[0] for k in found], [k[1] for k in found], [x[0] for x in found.values()], [x[1] for x in found.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["feature", "part", "toxic", "other"])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge; rows count by their weight, of which only the ratios matter."""
    weight = weight / weight.mean()
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (weight * (p - y)) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """(text, label, part, weight): of each class the `bound` labelled documents with the smallest hashes; part halves them.

    weight is the number of usable labels of its class that a row stands for: weighted, the rows have the class shares of
    all usable labels, whichever class meets the bound.
    """
    own = labels.select(F.col("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable).distinct()
    n = {r["label"]: r["count"] for r in own.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        part = part.withColumn("weight", F.lit(max(1.0, n.get(value, 0) / max(1, bound))))
        chosen = part if chosen is None else chosen.union(part)
    # of rows that share a labelled id one text is taken, so that the sample keeps to its bound
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select("text", "label", F.expr("pmod(xxhash64(doc_id, 5L), 2)").alias("part"), "weight")


def _of(counted: DataFrame, parts: tuple[int, ...]) -> DataFrame:
    return counted.where(F.col("part").isin(*parts)).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _patterns(counted: DataFrame, n: dict[tuple[int, int], int], parts: tuple[int, ...], support: int) -> dict[str, float]:
    """The patterns of the rows of these parts; none without rows of both classes. n: rows by part and class."""
    toxic, other = (sum(n.get((p, y), 0) for p in parts) for y in (1, 0))
    if not toxic or not other:
        return {}
    weight = F.log(((F.col("toxic") + 0.1) / (toxic + 0.2)) / ((F.col("other") + 0.1) / (other + 0.2)))
    # a pattern counts by the doubt that its few documents leave: two standard errors are taken off
    doubt = F.sqrt(1 / (F.col("toxic") + 0.1) + 1 / (F.col("other") + 0.5))
    top = _of(counted, parts).where(F.col("toxic") >= support).withColumn("weight", weight - doubt).where("weight > 1.5").orderBy(F.desc("weight"), "feature").collect()
    return {r["feature"]: round(r["weight"], 6) for r in top}


def _measured(rows: DataFrame, lexicon: Lexicon) -> list[tuple]:
    """The three measures of each row, its label and its weight, in a defined order."""

    @tidy()
    def measured(batches):
        automaton = lexicon.automaton()
        for batch in small(batches, ROWS):
            found = [measures(fold(t), automaton) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(3)] + [batch["toxic"].cast(pa.float64()), batch["weight"]], ["a", "b", "c", "y", "weight"])

    found = rows.select("text", "toxic", "weight").mapInArrow(measured, "a double, b double, c double, y double, weight double")
    return sorted(tuple(r) for r in found.collect())


def fit(documents: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", bound: int = 4096, support: int = 4, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns the lexicon from `bound` labelled rows of each class at most: the documented sample of a classifier.

    All rows give the lexicon. The factors of the logistic function come of rows that the lexicon has not seen: each half of the
    rows is measured by a lexicon of the other half. In them the classes count by their shares of all usable labels. Where a half
    lacks a class, its lexicon is empty, and where all do, the factors are those of measures that are all zero. Every pattern
    that enough toxic rows hold is taken, every phrase of a pattern's word that only other rows hold is an exception; exceptions adds
    the caller's own.
    """
    from .shared import long_texts, materialise

    long_texts(documents.sparkSession)
    rows = materialise(training_rows(documents, labels, label, usable, bound).withColumnRenamed("label", "toxic"), "toxic-rows")
    n = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = tuple(fold(x) for x in exceptions)
    if len({toxic for _, toxic in n}) < 2:
        return Lexicon({}, own, (-30.0, 0.0, 0.0, 0.0))
    counted = materialise(rows.mapInArrow(_features, _COUNTED).groupBy("feature", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxic-features")
    chosen = ((0, 1), (0,), (1,))
    weights = {parts: _patterns(counted, n, parts, support) for parts in chosen}
    words = {parts: frozenset(x.strip() for x in found if x.endswith(" ")) for parts, found in weights.items()}
    seen = rows.mapInArrow(lambda b: _phrases(b, frozenset().union(*words.values())), _COUNTED)
    seen = materialise(seen.groupBy("feature", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxic-phrases")

    def lexicon(parts: tuple[int, ...]) -> Lexicon:
        found = _of(seen, parts).where(f"toxic = 0 and other >= {support}").orderBy(F.desc("other"), "feature").collect()
        learned = [r["feature"] for r in found if r["feature"].split()[0] in words[parts]]
        return Lexicon(weights[parts], tuple(dict.fromkeys([*own, *learned])), (0.0, 0.0, 0.0, 0.0))

    whole = lexicon((0, 1))
    x = np.array([row for part in (0, 1) for row in _measured(rows.where(F.col("part") != part), lexicon((part,)))])
    return Lexicon(whole.weights, whole.exceptions, _logistic(x[:, :3], x[:, 3], x[:, 4]))
