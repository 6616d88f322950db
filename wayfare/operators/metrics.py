"""Retrieval, mapping and answer metrics over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "hit_rate", "reciprocal_rank")


def ratio(part: Column, whole: Column) -> Column:
    """The quotient, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def retrieval_metrics(questions: DataFrame, ranked: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, METRICS) of every question; keys: the question's columns, qid first.

    ranked: (keys, rank, node_id), of which repeats count once, at their first rank. labels: (qid, node_id).
    """
    keys = keys or ["qid"]
    first = ranked.groupBy(*keys, "node_id").agg(F.min("rank").alias("rank"))
    from pyspark.sql import Window

    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    wanted = labels.select("qid", "node_id").distinct()
    joined = placed.join(wanted.withColumn("hit", F.lit(1)), ["qid", "node_id"], "left")
    got = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"))
    size = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"))
    own = questions.select(*keys).distinct().join(got, keys, "left").join(size, "qid", "left")
    n, hits, total = (F.coalesce(x, F.lit(0)) for x in ("n", "hits", "wanted"))
    precision, recall = ratio(hits, n), ratio(hits, total)
    return own.select(
        *keys, precision.alias("precision"), recall.alias("recall"), harmonic(precision, recall).alias("f1"),
        F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_rate"), F.when(F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(F.lit(0.0)).alias("reciprocal_rank"),
    )


def macro(rows: DataFrame, by: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Means of the columns by group; each question's own value counts, null as 0."""
    return rows.groupBy(*by).agg(*[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])


def macro_by_type(rows: DataFrame, condition: str = "condition", kind: str = "question_type", columns: tuple[str, ...] = METRICS) -> DataFrame:
    """Overall means (null type) and means by type, in one pass."""
    sets = rows.groupingSets([[condition], [condition, kind]], condition, kind)
    return sets.agg(F.grouping(kind).cast("int").alias("overall"), *[F.avg(c).alias(c) for c in columns])


def set_f1(predicted: Column, relevant: Column) -> Column:
    """F1 of two arrays as sets."""
    both = F.size(F.array_intersect(predicted, relevant))
    return harmonic(ratio(both, F.size(F.array_distinct(predicted))), ratio(both, F.size(F.array_distinct(relevant))))


def list_f1(predicted: Column, relevant: Column) -> Column:
    """The same with precision over all predictions, repeats included."""
    both = F.size(F.array_intersect(predicted, relevant))
    return harmonic(ratio(both, F.size(predicted)), ratio(both, F.size(F.array_distinct(relevant))))


def mapping_outcome(matched: Column, intended: Column) -> Column:
    """exact, partial or empty."""
    same = (F.size(F.array_except(matched, intended)) == 0) & (F.size(F.array_except(intended, matched)) == 0)
    return F.when(same, "exact").when(F.size(matched) > 0, "partial").otherwise("empty")


def mapping_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled precision, recall and F1 and the share of exact sets, of (predicted, expected) arrays of node ids."""
    p, e = F.array_distinct("predicted"), F.array_distinct("expected")
    counted = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.size(F.array_intersect(p, e))).alias("true_positive"), F.sum(F.size(F.array_except(p, e))).alias("false_positive"),
        F.sum(F.size(F.array_except(e, p))).alias("false_negative"),
        F.count_if((F.size(F.array_except(p, e)) == 0) & (F.size(F.array_except(e, p)) == 0)).alias("exact_sets"),
    )
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("true_positive", "false_positive", "false_negative"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counted.select(*(by or []), "examples", tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), "exact_sets", precision.alias("precision"), recall.alias("recall"), harmonic(precision, recall).alias("f1"), ratio(F.col("exact_sets"), F.col("examples")).alias("exact_set_accuracy"))


def entity_metrics(rows: DataFrame) -> DataFrame:
    """Adds entity_precision, entity_recall, entity_f1, unsupported_node_ids and context_faithfulness.

    rows: arrays mentioned, excluded (seeds), relevant, and context_ids, null without a context. Faithfulness is null
    without a context and 1.0 where nothing is predicted.
    """
    predicted = F.filter("mentioned", lambda x: ~F.array_contains(F.coalesce("excluded", F.expr("cast(array() as array<string>)")), x))
    own = rows.withColumn("predicted", predicted)
    both = F.size(F.array_intersect("predicted", "relevant"))
    precision, recall = ratio(both, F.size("predicted")), ratio(both, F.size(F.array_distinct("relevant")))
    bare = F.when(F.col("context_ids").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array_except("predicted", F.coalesce("context_ids", F.expr("cast(array() as array<string>)"))))
    faithful = F.when(F.col("context_ids").isNull(), F.lit(None).cast("double")).when(F.size("predicted") == 0, F.lit(1.0)).otherwise((F.size("predicted") - F.size("unsupported_node_ids")) / F.size("predicted"))
    return own.withColumns({"entity_precision": precision, "entity_recall": recall, "entity_f1": harmonic(precision, recall), "unsupported_node_ids": bare}).withColumn("context_faithfulness", faithful)


def call_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Requests, cache hits, length-limited answers and tokens by group."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("network_request").alias("network"), F.count_if("cache_hit").alias("cached"), F.count_if(F.col("finish_reason") == "length").alias("length_limited"), zero("prompt_tokens"), zero("completion_tokens"), zero("total_tokens"))


def valid_ratings(rows: DataFrame, names: tuple[str, ...] = ("correctness", "completeness"), reason: str = "reason") -> DataFrame:
    """Rows whose ratings are whole numbers from 1 to 5 and whose reason isn't blank; others raise when read.

    Ratings are JSON text of a number, so that true and 3.0 are no ratings.
    """
    bad = F.trim(reason).isNull() | (F.trim(reason) == "")
    for name in names:
        bad = bad | ~F.coalesce(F.col(name).cast("string").rlike("^[1-5]$"), F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("the judge returned an invalid rating"))).otherwise(F.lit(True))
    out = rows.withColumns({name: F.col(name).cast("string").try_cast("int") for name in names} | {reason: F.trim(reason)})
    return out.where(checked)


def judge_means(rows: DataFrame) -> DataFrame:
    """Means of both ratings by condition and by data set and condition, in one pass."""
    sets = rows.groupingSets([["condition"], ["dataset", "condition"]], "dataset", "condition")
    return sets.agg(F.grouping("dataset").cast("int").alias("overall"), F.avg("correctness").alias("correctness"), F.avg("completeness").alias("completeness"))


def graph_summary(raw_nodes: DataFrame, raw_edges: DataFrame, first: str, second: str, category: str) -> tuple[DataFrame, DataFrame]:
    """Counts of a raw data set (one row) and its class histogram.

    raw_nodes: (id, category); raw_edges: numeric ids in the columns first and second.
    """
    from wayfare.operators.topology import canonical_edges

    edges = canonical_edges(raw_edges, first, second)
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    counts = raw_edges.agg(F.count(F.lit(1)).alias("raw_edge_rows"), F.count_if(F.col(first).cast("long") == F.col(second).cast("long")).alias("self_loops"))
    kept = edges.agg(F.count(F.lit(1)).alias("edges"))
    alone = raw_nodes.select(F.col("id").cast("long").alias("id")).join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    nodes = raw_nodes.agg(F.count(F.lit(1)).alias("nodes"))
    row = nodes.crossJoin(counts).crossJoin(kept).crossJoin(alone).withColumn("duplicates", F.col("raw_edge_rows") - F.col("self_loops") - F.col("edges"))
    return row, raw_nodes.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
