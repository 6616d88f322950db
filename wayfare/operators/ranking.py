"""BM25: the k best texts for every query, exact, without scoring every text that shares a common word.

A term's weight in a text is its inverse frequency times its saturated, length-normed count; the largest weight that any text has is
the term's bound. The rarer half of a query's terms is scored first: the k-th best of these partial scores is a floor of the
k-th best score. Terms whose bounds together stay under the floor can't carry a text into the best by themselves, so only texts
with one of the other terms are candidates, and only those get their whole scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.schema import above_zero, positive, share
from wayfare.sources.cut import kept

DIGITS = 9


def terms(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def weights(texts: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(term, id, weight) of the texts (id, text) for the terms of asked (term): an inverted index of these terms alone."""
    counted = texts.select("id", terms(F.col("text")).alias("t")).select("id", F.size("t").alias("length"), "t")
    size = kept(counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))
    held = counted.select("id", "length", F.explode("t").alias("term")).join(asked, "term", "left_semi").groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    held = kept(held)
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row
    known = frequency.crossJoin(F.broadcast(size)).select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "df")
    norm = F.lit(k1) * (1 - b + b * F.col("length") / F.col("mean"))
    return held.join(known, "term").select("term", "id", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("weight"), "df")


def bm25(queries: DataFrame, texts: DataFrame, k: int = 10, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, rank, id, score): for each query (qid, text) the k best texts (id, text), by score rounded to 9 digits, then id.

    A query's terms count once each; texts that share none are not listed. Null and empty texts have no terms, and count for the
    mean length. Ids of texts and of queries are unique.
    """
    positive("k", k), above_zero("k1", k1), share("b", b)
    asked = kept(queries.select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
    index = kept(weights(texts, asked.select("term").distinct(), k1, b))
    bounds = index.groupBy("term").agg(F.max("weight").alias("bound"), F.max("df").alias("df"))
    own = kept(asked.join(bounds, "term"))
    by_rarity = Window.partitionBy("qid").orderBy("df", "term")
    half = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("qid")) / 2)
    rare = own.withColumns({"nth": F.row_number().over(by_rarity), "half": half}).where("nth <= half").select("qid", "term")
    partial = rare.join(index, "term").groupBy("qid", "id").agg(F.sum("weight").alias("score"))
    first = partial.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("nth") == k)
    floor = first.select("qid", F.col("score").alias("floor"))
    # from the least bound on: terms whose sum stays under the floor, by more than rounding hides, need another term beside them
    up_to = F.sum("bound").over(Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    needed = own.withColumn("sum", up_to).join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("sum") > F.col("floor") - 10.0**-DIGITS)).select("qid", "term")
    candidates = needed.join(index.select("term", "id"), "term").select("qid", "id").distinct()
    whole = candidates.join(index, "id").join(own.select("qid", "term"), ["qid", "term"], "left_semi").groupBy("qid", "id").agg(F.round(F.sum("weight"), DIGITS).alias("score"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", "score")
