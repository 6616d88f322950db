"""The nine-arm study: one retrieval for all arms, contexts, copied arms, answers, blinding."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import any_fold, seeded_order
from wayfare.operators import matching, metrics, selection
from wayfare.operators.context import study_context
from wayfare.operators.propagation import direct_neighbours, propagate_biased
from wayfare.plans.strategies import ordered
from wayfare.schema import PAIRS, STUDY
from wayfare.sources.cut import kept
from wayfare.sources.graph import Graph
from wayfare.sources.language_model import Client
from wayfare.sources.model_calls import Calls, answers

ANSWER_PROMPT = "Answer the question briefly and name every entity asked for. Where graph context is given, rely on it alone for facts of the graph. If what you have does not suffice, say so."
ARM_PROMPT = "Choose one retrieval arm for the question, from the wording alone: C2, C3, C4, C5 or C6, from a plain random walk to full weight on low-degree targets. Return a JSON object with the key arm."


def retrieve(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(qid, condition, rank, node_id, score) of C1 to C6."""
    first = direct_neighbours(graph, seeds, top_k=STUDY.top_k, check=True).withColumn("condition", F.lit("C1"))
    arms = propagate_biased(graph, seeds, PAIRS, STUDY, check=True).withColumnRenamed("arm", "condition")
    return first.select("qid", "condition", "rank", "node_id", "score").unionByName(arms)


def contexts(graph: Graph, questions: DataFrame, keywords: DataFrame, arm_by_type: dict[str, str], fallback: str, *, max_chars: int | None = None, threshold: float = 0.85, margin: float = 0.10) -> DataFrame:
    """(qid, condition, ranked_node_ids, scores, context, context_node_ids, context_truncated, context_characters, reused_from).

    questions: (qid, question), without labels; keywords: (qid, position, keyword). The selector chooses by wording
    before anything is retrieved; C7 copies the arm that it chose.
    """
    choices = questions.select("qid", selection.select_arm(any_fold(F.col("question")), arm_by_type, fallback).alias("arm"))
    seeds = kept(matching.seeds_of(matching.approximate_match(graph, keywords, threshold=threshold, margin=margin)))
    found = kept(retrieve(graph, seeds))
    # a condition of a question is a context's key, so all arms' contexts are one plan
    key = F.concat_ws("|", "condition", "qid")
    conditions = ["C1", *PAIRS]
    names = graph.spark.createDataFrame([(c,) for c in conditions], "condition string")
    pairs = questions.select("qid").crossJoin(F.broadcast(names))
    keyed_seeds = seeds.join(pairs, "qid").select(key.alias("qid"), "node_id")
    shown = study_context(graph, pairs.select(key.alias("qid")), found.select(key.alias("qid"), "rank", "node_id", "score"), keyed_seeds, max_chars=max_chars)
    shown = shown.withColumnRenamed("qid", "key")
    own = found.withColumn("key", key)
    lists = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "score"))).alias("x"))
    none, zero = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<double>)")
    rows = pairs.withColumn("key", key).join(lists, "key", "left").join(shown, "key", "left").select(
        "qid", "condition", F.coalesce(F.transform("x", lambda v: v["node_id"]), none).alias("ranked_node_ids"), F.coalesce(F.transform("x", lambda v: v["score"]), zero).alias("scores"),
        "context", "context_node_ids", "context_truncated", "context_characters", F.lit(None).cast("string").alias("reused_from"),
    )
    empty = questions.select("qid", F.lit("C0").alias("condition"), none.alias("ranked_node_ids"), zero.alias("scores"), F.lit("").alias("context"), none.alias("context_node_ids"), F.lit(False).alias("context_truncated"), F.lit(0).alias("context_characters"), F.lit(None).cast("string").alias("reused_from"))
    rows = kept(rows)
    copied = selection.reuse_arm(rows.drop("reused_from"), choices, "C7").select(rows.columns)
    return empty.unionByName(rows).unionByName(copied)


def model_choices(questions: DataFrame, client: Calls | Client) -> DataFrame:
    """(qid, arm) that a model chooses by wording; every question is decided before any answer is read."""
    asked = questions.select("qid", F.lit(ARM_PROMPT).alias("system"), F.col("question").alias("user"), F.lit(True).alias("json_mode"))
    arm = json_value("content", "arm")
    # one key, and one of the arms: anything else is no decision
    sound = (F.json_object_keys("content") == F.array(F.lit("arm"))) & arm.isin(*[json.dumps(a) for a in PAIRS])
    found = kept(answers(asked, client).select("qid", F.when(sound, F.get_json_object("content", "$.arm")).alias("arm")))
    if not found.where("arm is null").limit(1).isEmpty():
        raise ValueError("the model must return one of the five arms")
    return found


def json_value(column: str, name: str) -> Column:
    """The JSON text of a value of a JSON object: quotes tell a text from a number; null where there is none."""
    return F.to_json(F.variant_get(F.try_parse_json(column), f"$.{name}", "variant"))


def add_model_arm(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """The rows and C8, a copy of the arm that the model chose."""
    return rows.unionByName(selection.reuse_arm(rows.drop("reused_from"), choices, "C8").select(rows.columns))


def generation_order(questions: DataFrame, seed: int, conditions: tuple[str, ...] = ("C0", "C1", *PAIRS)) -> DataFrame:
    """(qid, generation_order): the order in which a question's arms are answered, decided by seed and id."""
    return questions.select("qid", seeded_order(seed, F.col("qid"), conditions).alias("generation_order"))


def arm_answers(questions: DataFrame, rows: DataFrame, client: Calls | Client, seed: int = 90055, max_tokens: int = 256) -> DataFrame:
    """(qid, condition, answer): the model answers C0 to C6 of every question; C7 and C8 copy theirs.

    generation_order says which arms are asked; as requests are independent of each other and answered once each, executors take
    them in any order.
    """
    if isinstance(max_tokens, bool) or max_tokens < 1:
        raise ValueError("max_tokens must be a positive whole number")
    order = generation_order(questions, seed)
    asked = questions.select("qid", "question").join(order, "qid").select("qid", "question", F.explode("generation_order").alias("condition"))
    asked = asked.join(rows.select("qid", "condition", "context"), ["qid", "condition"])
    graph_context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n\nGraph context:\n"), "context")).otherwise("")
    user = F.concat(F.lit("Question: "), "question", graph_context)
    own = kept(answers(asked.select("qid", "condition", F.lit(ANSWER_PROMPT).alias("system"), user.alias("user"), F.lit(max_tokens).alias("max_tokens")), client))
    own = own.select("qid", "condition", F.col("content").alias("answer"))
    copies = rows.where("reused_from is not null").select("qid", F.col("condition").alias("name"), F.col("reused_from").alias("condition"))
    return own.unionByName(own.join(copies, ["qid", "condition"]).select("qid", F.col("name").alias("condition"), "answer"))


def answer_metrics(graph: Graph, given: DataFrame, rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, condition, metrics) of (qid, condition, answer); questions: (qid, seed_node_ids, relevant_node_ids).

    Seeds that the question names do not count; C0 has no context and so no faithfulness.
    """
    key = F.concat_ws("|", "condition", "qid")
    named = kept(ordered(matching.mentioned_nodes(graph, given.select(key.alias("qid"), F.col("answer").alias("text"))), "node_id", "mentioned"))
    shown = rows.where("condition <> 'C0'").select(key.alias("qid"), F.col("context").alias("text"))
    seen = kept(ordered(matching.mentioned_nodes(graph, shown), "node_id", "context_ids"))
    none = F.expr("cast(array() as array<string>)")
    own = given.withColumn("key", key).join(named.withColumnRenamed("qid", "key"), "key", "left").join(seen.withColumnRenamed("qid", "key"), "key", "left").join(questions, "qid")
    own = own.withColumns({"mentioned": F.coalesce("mentioned", none), "context_ids": F.when(F.col("condition") == "C0", F.lit(None)).otherwise(F.coalesce("context_ids", none)), "excluded": F.col("seed_node_ids"), "relevant": F.col("relevant_node_ids")})
    return metrics.entity_metrics(own).select("qid", "condition", "entity_precision", "entity_recall", "entity_f1", "unsupported_node_ids", "context_faithfulness")


def blind_cases(given: DataFrame, seed: int, conditions: tuple[str, ...]) -> DataFrame:
    """(qid, label, condition, answer): answers under letters, in an order that seed and id decide."""
    letters = F.posexplode(seeded_order(seed, F.col("qid"), conditions)).alias("place", "condition")
    order = given.select("qid").distinct().select("qid", letters)
    return order.join(given, ["qid", "condition"]).select("qid", F.chr(F.col("place") + 65).alias("label"), "condition", "answer")


def arm_scores(graph: Graph, questions: DataFrame, keywords: DataFrame, *, threshold: float = 0.85, margin: float = 0.10) -> DataFrame:
    """(qid, question_type, arm, f1) of the five fixed arms over a labelled development set (qid, question_type, relevant_node_ids)."""
    seeds = matching.seeds_of(matching.approximate_match(graph, keywords, threshold=threshold, margin=margin))
    found = propagate_biased(graph, seeds, PAIRS, STUDY, check=True)
    names = graph.spark.createDataFrame([(a,) for a in PAIRS], "arm string")
    pairs = questions.select("qid").crossJoin(F.broadcast(names))
    labels = questions.select("qid", F.explode("relevant_node_ids").alias("node_id"))
    rows = metrics.retrieval_metrics(pairs, found, labels, ["qid", "arm"])
    return rows.join(questions.select("qid", "question_type"), "qid").select("qid", "question_type", "arm", "f1")


def tune_selector(scores: DataFrame) -> dict[str, DataFrame]:
    """The trained selector, its held-out decisions, and the upper bound that always knows the best arm."""
    scores = selection.require_arms(scores)
    return {"selector": selection.train_selector(scores), "decisions": selection.leave_one_out(scores), "oracle": selection.oracle_mean(scores)}


def model_selector_report(scores: DataFrame, choices: DataFrame) -> DataFrame:
    """(selected_mean_f1, best_fixed_mean_f1, oracle_mean_f1) of a model's choices (qid, arm)."""
    chosen = scores.join(choices, ["qid", "arm"]).agg(F.avg("f1").alias("selected_mean_f1"))
    fixed = scores.join(selection.best_arm(scores), "arm").agg(F.avg("f1").alias("best_fixed_mean_f1"))
    return chosen.crossJoin(fixed).crossJoin(selection.oracle_mean(scores))


def analyse(rows: DataFrame, questions: DataFrame, matched: DataFrame, *, samples: int = 10_000, seed: int = 90055) -> dict[str, DataFrame]:
    """Retrieval F1 by question and arm, means, mapping outcomes, selections, and intervals against the best fixed arm.

    rows: contexts of all arms; questions: (qid, question_type, seed_node_ids, relevant_node_ids); matched: (qid, matched_seed_ids).
    Each comparison starts its stream of resamples anew.
    """
    from pyspark.sql import Window

    labelled = rows.where("condition <> 'C0'").join(questions, "qid")
    f1 = labelled.select("qid", "question_type", "condition", metrics.set_f1(F.col("ranked_node_ids"), F.col("relevant_node_ids")).alias("f1")).cache()
    none = F.expr("cast(array() as array<string>)")
    outcome = questions.join(matched, "qid", "left").select(metrics.mapping_outcome(F.coalesce("matched_seed_ids", none), F.col("seed_node_ids")).alias("outcome"))
    best = selection.best_arm(f1.where(F.col("condition").isin(*PAIRS)).withColumnRenamed("condition", "arm")).first()["arm"]
    place = f1.select("qid").distinct().withColumn("position", F.row_number().over(Window.orderBy("qid")) - 1)
    compared = [c for c in ("C1", "C7", "C8") if not f1.where(F.col("condition") == c).isEmpty()]
    differences = selection.paired_differences(f1, best).where(F.col("condition").isin(*compared)).join(place, "qid")
    return {
        "f1": f1,
        "means": metrics.macro_by_type(f1, columns=("f1",)),
        "mapping": outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
        "selections": rows.where("reused_from is not null").groupBy("condition", "reused_from").agg(F.count(F.lit(1)).alias("n")),
        "intervals": selection.bootstrap(differences, compared, samples=samples, seed=seed, inner_index=False).withColumn("against", F.lit(best)),
    }


JUDGE_PROMPT = "Rate the candidate's answer against the gold entities alone: correctness and completeness, each a whole number from 1 (worst) to 5 (best). Return a JSON object with correctness, completeness and a short reason."


def pilot(questions: DataFrame, given: DataFrame, judge: Calls | Client, conditions: tuple[str, ...] = ("C0", "C1", "C7", "C8"), seed: int = 90055) -> dict[str, DataFrame]:
    """A blinded pilot: one question of each type by hash, answers under letters, a judge's checked ratings and their means.

    questions: (qid, question, question_type, dataset, gold: text); given: (qid, condition, answer).
    """
    chosen = questions.join(selection.hash_sample(questions, seed).select("qid"), "qid", "left_semi")
    cases = blind_cases(given.join(chosen.select("qid"), "qid", "left_semi"), seed, conditions)
    user = F.concat(F.lit("Question: "), "question", F.lit("\nGold entities: "), "gold", F.lit("\nCandidate "), "label", F.lit(": "), "answer")
    asked = cases.join(chosen, "qid").select("qid", "dataset", "condition", F.lit(JUDGE_PROMPT).alias("system"), user.alias("user"), F.lit(True).alias("json_mode"))
    # numbers as JSON, so that true and 3.0 are seen to be no ratings; a reason is a text
    reason = F.when(json_value("content", "reason").startswith('"'), F.get_json_object("content", "$.reason"))
    raw = kept(answers(asked, judge)).select("qid", "dataset", "condition", json_value("content", "correctness").alias("correctness"), json_value("content", "completeness").alias("completeness"), reason.alias("reason"))
    checked = metrics.valid_ratings(raw)
    return {"cases": cases, "ratings": checked, "means": metrics.judge_means(checked)}


TWO_ARMS = {"model": "Answer the question briefly and name every entity asked for. Say so if you do not know.", "grounded": ANSWER_PROMPT}


def answer_quality(graph: Graph, questions: DataFrame, found: DataFrame, client: Calls | Client, seed: int = 90055) -> dict[str, DataFrame]:
    """Two arms, without and with the saved context (qid, context): answers, metrics, means, and blind pairs.

    questions: (qid, question, seed_node_ids, relevant_node_ids).
    """
    from wayfare.functions.text import blind_first, pair_id

    both = questions.select("qid", "question").join(found, "qid")
    grounded = F.concat(F.lit("Question: "), "question", F.lit("\n\nGraph context:\n"), "context")
    arms = F.array(F.struct(F.lit("C0").alias("condition"), F.lit(TWO_ARMS["model"]).alias("system"), F.col("question").alias("user")), F.struct(F.lit("C1").alias("condition"), F.lit(TWO_ARMS["grounded"]).alias("system"), grounded.alias("user")))
    given = kept(answers(both.select("qid", F.inline(arms)), client)).select("qid", "condition", F.col("content").alias("answer"))
    rows = answer_metrics(graph, given, found.select("qid", F.lit("C1").alias("condition"), "context"), questions.select("qid", "seed_node_ids", "relevant_node_ids"))
    means = metrics.macro(rows, ["condition"], ("entity_precision", "entity_recall", "entity_f1", "context_faithfulness"))
    both = given.groupBy("qid").pivot("condition", ["C0", "C1"]).agg(F.first("answer"))
    first = blind_first(seed, F.col("qid")) == 0
    blind = both.select(pair_id(seed, F.col("qid")).alias("pair"), F.when(first, F.col("C0")).otherwise(F.col("C1")).alias("answer_a"), F.when(first, F.col("C1")).otherwise(F.col("C0")).alias("answer_b"), F.when(first, "C0").otherwise("C1").alias("key_a"))
    return {"answers": given, "metrics": rows, "means": means, "blind": blind}
