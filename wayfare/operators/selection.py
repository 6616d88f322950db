"""Tuning, selectors, resampling: choices from tables of scores. Means are rounded to 12 digits before they compare."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.text import question_type, seeded_digest
from wayfare.operators.metrics import harmonic, retrieval_metrics
from wayfare.operators.propagation import ranked, weighted_best
from wayfare.schema import PAIRS, QUESTION_TYPES, positive
from wayfare.sources.cut import kept, written
from wayfare.sources.graph import Graph

DIGITS = 12


def require_arms(scores: DataFrame) -> DataFrame:
    """scores (qid, question_type, arm, f1): raises unless every question has each of the five arms once."""
    arms = ",".join(sorted(PAIRS))
    bad = scores.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("arm")), ",").alias("arms")).where(F.col("arms") != arms)
    if scores.limit(1).isEmpty():
        raise ValueError("at least one development row is required")
    if not bad.limit(1).isEmpty():
        raise ValueError("each row must score all five fixed arms")
    return scores


def _best(scores: DataFrame, by: list[str], value: Column) -> DataFrame:
    means = scores.groupBy(*by, "arm").agg(F.round(F.avg(value), DIGITS).alias("mean"))
    order = Window.partitionBy(*by).orderBy(F.col("mean").desc(), "arm") if by else Window.orderBy(F.col("mean").desc(), "arm")
    return means.withColumn("n", F.row_number().over(order)).where("n = 1").select(*by, "arm")


def best_arm(scores: DataFrame) -> DataFrame:
    """(arm) of the highest mean F1; ties go to the lowest arm."""
    return _best(scores, [], F.col("f1"))


def train_selector(scores: DataFrame) -> DataFrame:
    """(question_type, arm) for all four types; a type without rows gets the best arm of all."""
    spark = scores.sparkSession
    kinds = spark.createDataFrame([(k,) for k in QUESTION_TYPES], "question_type string")
    typed = _best(scores, ["question_type"], F.col("f1"))
    return kinds.join(typed, "question_type", "left").crossJoin(F.broadcast(best_arm(scores).withColumnRenamed("arm", "fallback"))).select("question_type", F.coalesce("arm", "fallback").alias("arm"))


def select_arm(folded_question: Column, arm_by_type: dict[str, str], fallback: str) -> Column:
    """The arm by wording alone."""
    if set(arm_by_type) != set(QUESTION_TYPES):
        raise ValueError("a selector must configure all four question types")
    for arm in (*arm_by_type.values(), fallback):
        if arm not in PAIRS:
            raise ValueError(f"unknown arm: {arm}")
    found = F.lit(fallback)
    kind = question_type(folded_question)
    for name, arm in arm_by_type.items():
        found = F.when(kind == name, F.lit(arm)).otherwise(found)
    return found


def leave_one_out(scores: DataFrame) -> DataFrame:
    """(qid, question_type, selected_arm, selected_f1, global_arm, global_f1), each question held out once.

    A mean without one row is (sum - own) / (count - 1), so nothing is trained again.
    """
    def held_out(by: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*by, "arm") if by else Window.partitionBy("arm")
        n, total = F.count(F.lit(1)).over(w), F.sum("f1").over(w)
        means = scores.withColumn("mean", F.when(n > 1, F.round((total - F.col("f1")) / (n - 1), DIGITS)))
        order = Window.partitionBy("qid").orderBy(F.col("mean").desc(), "arm")
        return means.where("mean is not null").withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", F.col("arm").alias(name))

    chosen = scores.select("qid", "question_type").distinct().join(held_out([], "global_arm"), "qid").join(held_out(["question_type"], "typed_arm"), "qid", "left")
    chosen = chosen.withColumn("selected_arm", F.coalesce("typed_arm", "global_arm"))
    f1 = scores.select("qid", "arm", "f1")
    out = chosen.join(f1.withColumnsRenamed({"arm": "selected_arm", "f1": "selected_f1"}), ["qid", "selected_arm"])
    return out.join(f1.withColumnsRenamed({"arm": "global_arm", "f1": "global_f1"}), ["qid", "global_arm"]).select("qid", "question_type", "selected_arm", "selected_f1", "global_arm", "global_f1")


def oracle_mean(scores: DataFrame) -> DataFrame:
    """The mean of each question's best arm: an upper bound, no selector."""
    return scores.groupBy("qid").agg(F.max("f1").alias("f1")).agg(F.avg("f1").alias("oracle_mean_f1"))


def reuse_arm(conditions: DataFrame, choices: DataFrame, name: str) -> DataFrame:
    """Rows of a new condition, copied from the arm that (qid, arm) chose; nothing runs again."""
    chosen = choices.select("qid", F.col("arm").alias("condition"))
    return conditions.join(chosen, ["qid", "condition"]).withColumns({"reused_from": F.col("condition"), "condition": F.lit(name)})


def parameter_grid(graph: Graph, seeds: DataFrame, labels: DataFrame, depths: tuple[int, ...] = (1, 2, 3), decays: tuple[float, ...] = (0.3, 0.5, 0.6, 0.75), tops: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(depth, decay, top_k, precision, recall, f1): means over questions of every configuration.

    The graph is walked once, to the greatest depth; a configuration is a weighting of the hops' masses.
    """
    spark = graph.spark
    cells = spark.createDataFrame([(d, float(x)) for d in depths for x in decays], "depth int, decay double")
    best = weighted_best(graph, seeds, max(depths), seeds.select("qid").distinct().crossJoin(F.broadcast(cells)), max(tops))
    # the longest list once; shorter ones are its beginnings
    listed = written(ranked(best, ["qid", "depth", "decay"], max(tops), F.col("node_id").asc()))
    sizes = spark.createDataFrame([(k,) for k in tops], "top_k int")
    own = listed.join(F.broadcast(sizes), F.col("rank") <= F.col("top_k")).select("qid", "depth", "decay", "top_k", "rank", "node_id")
    questions = seeds.select("qid").distinct().crossJoin(F.broadcast(cells.crossJoin(sizes)))
    rows = retrieval_metrics(questions, own, labels, ["qid", "depth", "decay", "top_k"])
    return rows.groupBy("depth", "decay", "top_k").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def best_parameters(grid: DataFrame) -> DataFrame:
    """One row: highest F1, then recall, then the fewest nodes, the least depth and decay."""
    return grid.orderBy(F.round("f1", DIGITS).desc(), F.round("recall", DIGITS).desc(), "top_k", "depth", "decay").limit(1)


def best_mapping(results: DataFrame) -> DataFrame:
    """One row: highest precision, F1 and recall, then the most careful threshold and margin."""
    return results.orderBy(*[F.round(c, DIGITS).desc() for c in ("precision", "f1", "recall")], F.desc("threshold"), F.desc("margin")).limit(1)


def resamples(n: int, samples: int, seed: int, draws: int = 1) -> list[list[list[int]]]:
    """Index lists of `draws` consecutive resamplings, all of one random stream, as the published intervals drew them."""
    rng = random.Random(seed)
    return [[[rng.randrange(n) for _ in range(n)] for _ in range(samples)] for _ in range(draws)]


def drawn(spark: SparkSession, order: list[str], n: int, samples: int, seed: int, one_stream: bool) -> DataFrame:
    """(condition, sample, at): the same lists as resamples gives, drawn and sent on by one task, a few hundred at a time."""

    def lists(batches):
        for _ in batches:
            pass
        step = max(1, 100_000 // n)
        rng = random.Random(seed)
        for name in order:
            rng = rng if one_stream else random.Random(seed)
            for first in range(0, samples, step):
                size = min(step, samples - first)
                at = [[rng.randrange(n) for _ in range(n)] for _ in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(range(first, first + size), pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["condition", "sample", "at"])

    return spark.range(0, 1, 1, 1).mapInArrow(lists, "condition string, sample int, at array<int>").repartition("condition", "sample")


def bootstrap(differences: DataFrame, order: list[str], *, samples: int = 10_000, seed: int = 90055, inner_index: bool = True, draws: list[list[list[int]]] | None = None) -> DataFrame:
    """(condition, mean_difference, ci95_lower, ci95_upper) of (condition, position, difference).

    order: the conditions as they were met. inner_index: one stream runs through all conditions and percentiles are at
    int(q * (samples - 1)); else each condition starts the stream anew and they are at int(q * samples).
    A resample's differences are added in the order they were drawn; questions are numbered from 0.
    """
    spark = differences.sparkSession
    n = differences.groupBy("condition").count().agg(F.max("count")).first()[0]
    if not n:
        raise ValueError("paired samples must have a nonzero length")
    if draws is None:
        table = drawn(spark, order, n, samples, seed, inner_index)
    else:
        table = spark.createDataFrame([(name, s, own) for name, part in zip(order, draws) for s, own in enumerate(part)], "condition string, sample int, at array<int>")
    lists = differences.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("position", "difference"))).alias("rows")).select("condition", F.transform("rows", lambda x: x["difference"]).alias("d"))
    means = table.join(lists, "condition").select("condition", (F.aggregate("at", F.lit(0.0), lambda acc, i: acc + F.get("d", i)) / F.size("at")).alias("mean"))
    low, high = (int(0.025 * (samples - 1)), int(0.975 * (samples - 1))) if inner_index else (int(samples * 0.025), int(samples * 0.975))
    edges = means.groupBy("condition").agg(F.array_sort(F.collect_list("mean")).alias("m")).select("condition", F.get("m", F.lit(low)).alias("ci95_lower"), F.get("m", F.lit(high)).alias("ci95_upper"))
    return differences.groupBy("condition").agg(F.avg("difference").alias("mean_difference")).join(edges, "condition")


def hash_sample(questions: DataFrame, seed: int = 90055) -> DataFrame:
    """(question_type, qid): of each type the question with the smallest seeded digest."""
    return questions.groupBy("question_type").agg(F.min_by("qid", F.struct(seeded_digest(seed, F.col("qid")), "qid")).alias("qid"))


def first_disjoint(candidates: DataFrame, n: int, order: tuple[str, ...] = ("at", "seeds"), seeds: str = "seeds") -> DataFrame:
    """The n rows that are chosen in turn, in the order of `order`, each unless one chosen before shares a seed with it.

    Fewer if there are no more. Whether a row is chosen depends on earlier rows alone, so the first few are decided first, and
    more only if they don't give n. They are decided in rounds, all at once: a row that is the first of all undecided ones for
    each of its seeds is chosen, and those that share a seed with it go. Rows that are equal in `order` count as one.
    """
    candidates, size = kept(candidates), 4 * positive("n", n)
    total = candidates.count()
    while True:
        own = candidates if size >= total else candidates.orderBy(*order).limit(size)
        chosen = kept(_disjoint(own, order, seeds))
        if size >= total or chosen.count() >= n:
            return chosen.orderBy(*order).limit(n)
        size *= 4


def _disjoint(candidates: DataFrame, order: tuple[str, ...], seeds: str) -> DataFrame:
    left = kept(candidates.dropDuplicates(list(order)).withColumn("_order", F.struct(*order)))
    chosen = left.limit(0)
    while not left.isEmpty():
        by_seed = left.select("_order", F.explode(F.array_distinct(seeds)).alias("_seed"))
        first = by_seed.groupBy("_seed").agg(F.min("_order").alias("_first"))
        sure = by_seed.join(first, "_seed").groupBy("_order").agg(F.min(F.col("_order") == F.col("_first")).alias("sure")).where("sure").select("_order")
        won = kept(left.join(sure, "_order", "left_semi"))
        chosen = chosen.unionByName(won)
        taken = won.select(F.explode(seeds).alias("_seed")).distinct()
        gone = by_seed.join(taken, "_seed", "left_semi").select("_order").distinct()
        left = kept(left.join(gone, "_order", "left_anti"))
    return chosen.drop("_order")


def paired_differences(rows: DataFrame, baseline: str, value: str = "f1") -> DataFrame:
    """(condition, qid, difference) from the baseline condition, which is left out."""
    base = rows.where(F.col("condition") == baseline).select("qid", F.col(value).alias("base"))
    return rows.where(F.col("condition") != baseline).join(base, "qid").select("condition", "qid", (F.col(value) - F.col("base")).alias("difference"))


def per_question_f1(precision: Column, recall: Column) -> Column:
    return harmonic(precision, recall)
