"""Command line: ask one question, or compare strategies over a file of questions."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import SparkSession

from wayfare.plans import experiment, strategies
from wayfare.schema import STRATEGIES, BiasConfig, Parameters
from wayfare.sources.files import read_questions, write_jsonl
from wayfare.sources.graph import Graph
from wayfare.sources.language_model import Http


KINDS = {"int": int, "float": float, "float | None": float, "str": str}


def add_fields(parser: argparse.ArgumentParser, config: type, prefix: str = "") -> None:
    """An option for each field of a configuration, with its default."""
    for f in fields(config):
        parser.add_argument(f"--{prefix}{f.name.replace('_', '-')}", type=KINDS[f.type], default=f.default)


def configured(args: argparse.Namespace, config: type, prefix: str = ""):
    """The configuration that the options give, checked."""
    return config(**{f.name: getattr(args, prefix + f.name) for f in fields(config)}).validate()


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayfare", description=__doc__)
    top.add_argument("--nodes", required=True, help="CSV file or folder of nodes")
    top.add_argument("--edges", required=True, help="CSV file or folder of edges")
    top.add_argument("--backend", choices=["walk", "biased"], default="walk")
    add_fields(top, BiasConfig, "bias-")
    commands = top.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--strategy", choices=STRATEGIES, default="rules")
    ask.add_argument("--no-answer", action="store_true")
    many = commands.add_parser("experiment")
    many.add_argument("--questions", required=True)
    many.add_argument("--output", required=True)
    many.add_argument("--strategies", nargs="+", choices=STRATEGIES, default=["seed-only", "fixed", "rules"])
    for command in (ask, many):
        add_fields(command, Parameters)
        command.add_argument("--match-mode", choices=["exact", "approximate"], default="exact")
        command.add_argument("--match-threshold", type=float, default=0.85)
        command.add_argument("--match-margin", type=float, default=0.10)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    args = arguments().parse_args(argv)
    fixed = configured(args, Parameters)
    spark = spark or SparkSession.builder.appName("wayfare").getOrCreate()
    graph = Graph.from_csv(spark, args.nodes, args.edges).keep("arcs", "totals", "titles")
    client = Http.from_environment()
    backend = configured(args, BiasConfig, "bias_") if args.backend == "biased" else None
    how = {"client": client, "backend": backend, "match_mode": args.match_mode, "threshold": args.match_threshold, "margin": args.match_margin}
    if args.command == "ask":
        questions = spark.createDataFrame([("q", args.question)], "qid string, question string")
        done = strategies.run(graph, questions, args.strategy, fixed=fixed, **how)
        rows = strategies.results(graph, questions, args.strategy, done)
        out = rows if args.no_answer else strategies.answered(rows, client)
    else:
        conditions = tuple((s, s, fixed if s in {"fixed", "llm-keywords"} else None) for s in args.strategies)
        rows = experiment.compare(graph, read_questions(spark, args.questions), conditions, **how).cache()
        write_jsonl(rows, args.output)
        out = experiment.summary(rows)
    found = [json.loads(x) for x in out.toJSON().collect()]
    print(json.dumps(found, indent=2, ensure_ascii=False))
    return found


if __name__ == "__main__":
    main()
