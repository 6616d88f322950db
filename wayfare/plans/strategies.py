"""From questions to ranked nodes and contexts: a strategy gives keywords and parameters, the rest is one plan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.text import explicit_user_ids, rule_parameters, with_folded
from wayfare.operators import matching
from wayfare.operators.context import context
from wayfare.operators.propagation import direct_neighbours, propagate, propagate_biased
from wayfare.schema import STRATEGIES, BiasConfig, Parameters
from wayfare.sources.cut import kept
from wayfare.sources.graph import Graph
from wayfare.sources.language_model import Client
from wayfare.sources.model_calls import Calls, answers

NO_ANSWER = "LLM answer generation skipped. Set OPENAI_API_KEY to generate an answer."
_DEPTHS = "depth: 1 for direct facts, 2 to explain or compare, 3 for chains of links; decay: from 0 to 1, the weight of far evidence; top_k: 5, 10 or 20."
PROMPTS = {
    "llm": f"Plan a graph search for the question. Return a JSON object with keywords (the entities, copied exactly), depth, decay and top_k. {_DEPTHS}",
    "llm-keywords": "List the entities of the question that name nodes of a graph, each copied exactly and whole. Return a JSON object with the key keywords.",
    "llm-parameters": f"Choose how a graph search should run for the question. Return a JSON object with depth, decay and top_k. {_DEPTHS}",
    "llm-parameters-few-shot": f"Choose how a graph search should run for the question. Return a JSON object with depth, decay and top_k. {_DEPTHS} Examples: neighbours of one page: 1, 0.4, 10. Common neighbours of two pages: 1, 0.6, 10. The shortest path between two pages: 2, 0.75, 20. Pages of one category two links away: 2, 0.7, 10.",
    "answer": "Answer from the graph context alone, and say so if it does not suffice.",
}


#: Strategies that take keywords from the question itself.
LOCAL = ("seed-only", "fixed", "rules", "llm-parameters", "llm-parameters-few-shot")


@dataclass(frozen=True)
class Plan:
    """keywords (qid, position, keyword) and parameters (qid, depth, decay, top_k): a batch's logical plan."""

    keywords: DataFrame
    parameters: DataFrame


_PLANNED = "struct<depth:int,decay:double,top_k:int,words:array<string>,fault:string>"


def _read(content: str, strategy: str) -> dict:
    """The parts of a plan that the strategy takes from a model's JSON, or what is wrong with it."""
    try:
        data = json.loads(content)
        if not isinstance(data, dict):
            raise ValueError("the model must return a JSON object")
        found: dict = {"words": [str(x).strip() for x in data.get("keywords", []) if str(x).strip()]}
        if strategy != "llm-keywords":
            own = Parameters(int(data["depth"]), float(data["decay"]), int(data["top_k"])).validate()
            if own.top_k not in {5, 10, 20}:
                raise ValueError("LLM top_k must be 5, 10, or 20")
            found |= asdict(own)
        return found
    except (KeyError, TypeError, ValueError) as error:
        return {"fault": f"{type(error).__name__}: {error}"}


def model_plans(questions: DataFrame, strategy: str, client: Calls | Client) -> DataFrame:
    """(question, depth, decay, top_k, words) of every distinct question, from a model; the first fault raises."""

    @F.arrow_udf(_PLANNED)
    def read(content: pa.Array) -> pa.Array:
        kind = pa.struct([("depth", pa.int32()), ("decay", pa.float64()), ("top_k", pa.int32()), ("words", pa.list_(pa.string())), ("fault", pa.string())])
        return pa.array([_read(x, strategy) for x in content.to_pylist()], kind)

    asked = questions.select("question").distinct().select(F.lit(PROMPTS[strategy]).alias("system"), F.col("question").alias("user"), F.lit(True).alias("json_mode"))
    found = kept(answers(asked, client).select(F.col("user").alias("question"), read("content").alias("p")).select("question", "p.*"))
    if fault := found.where("fault is not null").orderBy("question").first():
        raise ValueError(f"{fault['fault']} (asked for {fault['question']!r})")
    return found.drop("fault")


def plan(graph: Graph, questions: DataFrame, strategy: str, *, fixed: Parameters | None = None, client: Calls | Client | None = None, local: DataFrame | None = None) -> Plan:
    """questions: (qid, question). Strategies with a model ask it once a distinct question (see model_calls).

    local: the questions' own keywords, where they are known already.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    fixed = (fixed or Parameters()).validate()
    questions = questions.select(F.col("qid").cast("string").alias("qid"), "question")
    if strategy.startswith("llm") and client is None:
        raise RuntimeError(f"the {strategy} strategy requires OPENAI_API_KEY")

    def same(p: Parameters) -> DataFrame:
        return questions.select("qid", *[F.lit(v).alias(k) for k, v in asdict(p).items()])

    if strategy in LOCAL:
        local = matching.keywords_or_heuristic(graph, questions) if local is None else local
    if strategy in {"seed-only", "fixed", "rules"}:
        if strategy == "rules":
            folded = with_folded(questions, "question", "norm").select("qid", rule_parameters(F.col("norm")).alias("p"))
            return Plan(local, folded.select("qid", "p.*"))
        return Plan(local, same(fixed if strategy == "fixed" else Parameters(0, 0.0, 10)))
    planned = model_plans(questions, strategy, client)
    parameters = same(fixed)
    if strategy != "llm-keywords":
        parameters = questions.join(planned.select("question", "depth", "decay", "top_k"), "question").drop("question")
    if strategy.startswith("llm-parameters"):
        return Plan(local, parameters)
    own = questions.join(planned.select("question", "words"), "question")
    if strategy == "llm-keywords":
        exact = explicit_user_ids(F.col("question"))
        own = own.withColumn("words", F.when(F.size(exact) > 0, exact).otherwise(F.col("words")))
        if not own.where(F.size("words") == 0).limit(1).isEmpty():
            raise ValueError("LLM must return at least one keyword")
    listed = own.select("qid", F.posexplode("words").alias("position", "keyword"))
    rest = own.where(F.size("words") == 0).select("qid", F.posexplode(matching.heuristic_keywords(F.col("question"))).alias("position", "keyword"))
    return Plan(listed.unionByName(rest), parameters)


@dataclass(frozen=True)
class Run:
    """What a batch gave: seeds (qid, node_id, position), matches or None, unmatched, ranked, contexts."""

    plan: Plan
    seeds: DataFrame
    matches: DataFrame | None
    unmatched: DataFrame
    ranked: DataFrame
    contexts: DataFrame


def matched(graph: Graph, keywords: DataFrame, match_mode: str = "exact", threshold: float = 0.85, margin: float = 0.10) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Seeds, unmatched keywords and, for approximate matching, all matches."""
    if match_mode == "exact":
        seeds, unmatched = matching.exact_match(graph, keywords)
        return kept(seeds), unmatched, None
    if match_mode != "approximate":
        raise ValueError("match_mode must be exact or approximate")
    matches = kept(matching.approximate_match(graph, keywords, threshold=threshold, margin=margin))
    return kept(matching.seeds_of(matches)), matches.where("not accepted").select("qid", "position", "keyword"), matches


def run(graph: Graph, questions: DataFrame, strategy: str = "rules", *, fixed: Parameters | None = None, client: Calls | Client | None = None, match_mode: str = "exact", threshold: float = 0.85, margin: float = 0.10, backend: BiasConfig | None = None) -> Run:
    """All questions at once: keywords, seeds, propagation, context.

    backend: None walks the weighted graph; a BiasConfig walks the simple graph with its degree exponents: exactly for query
    type N, sampled under its error bound for S.
    """
    own = plan(graph, questions, strategy, fixed=fixed, client=client)
    # what several results read is kept, a few rows a question, so that their plans stay small
    own = Plan(kept(own.keywords), kept(own.parameters))
    seeds, unmatched, matches = matched(graph, own.keywords, match_mode, threshold, margin)
    if backend is None:
        ranked = propagate(graph, seeds, own.parameters)
    else:
        ranked = propagate_biased(graph, seeds, {"one": (backend.a, backend.b)}, own.parameters, query_type=backend.query_type, check=True, backend=backend).drop("arm")
    ranked = kept(ranked)
    return Run(own, seeds, matches, unmatched, ranked, context(graph, questions.select(F.col("qid").cast("string").alias("qid")), ranked))


def ordered(df: DataFrame, value: str, out: str, order: str = "position") -> DataFrame:
    """(qid, array of values in order)."""
    return df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("x")).select("qid", F.transform("x", lambda v: v[value]).alias(out))


def results(graph: Graph, questions: DataFrame, strategy: str, done: Run) -> DataFrame:
    """One row a question: keywords, seeds, unmatched, parameters, ranked nodes with titles and scores, context."""
    named = done.ranked.join(graph.nodes.select(F.col("id").alias("node_id"), "title"), "node_id")
    nodes = named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "title", "score"))).alias("ranked_nodes"))
    none = F.expr("cast(array() as array<string>)")
    out = questions.select(F.col("qid").cast("string").alias("qid"), "question").withColumn("strategy", F.lit(strategy))
    for df, value, name in ((done.plan.keywords, "keyword", "keywords"), (done.seeds, "node_id", "matched_seed_ids"), (done.unmatched, "keyword", "unmatched_keywords")):
        out = out.join(ordered(df, value, name), "qid", "left").withColumn(name, F.coalesce(name, none))
    return out.join(done.plan.parameters, "qid", "left").join(nodes, "qid", "left").join(done.contexts, "qid", "left")


def answered(rows: DataFrame, client: Calls | Client | None) -> DataFrame:
    """Adds answer: from the model, asked once a (question, context), or the words that it was skipped."""
    if client is None:
        return rows.withColumn("answer", F.lit(NO_ANSWER))
    user = F.concat(F.lit("Question: "), "question", F.lit("\n\nGraph context:\n"), F.coalesce("context", F.lit("")))
    return answers(rows.withColumns({"system": F.lit(PROMPTS["answer"]), "user": user}), client).withColumnRenamed("content", "answer").drop("system", "user")


def neighbours_baseline(graph: Graph, seeds: DataFrame, top_k: int = 10) -> DataFrame:
    """The study's first arm."""
    return direct_neighbours(graph, seeds, top_k=top_k)
