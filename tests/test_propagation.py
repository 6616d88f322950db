import random

import pytest
from pyspark.sql import functions as F
from helpers import rows
from test_graph import graph_of

from wayfare.operators import propagation as pr
from wayfare.operators.selection import parameter_grid
from wayfare.schema import PAIRS, Parameters


def seeds(spark, *own):
    return spark.createDataFrame(list(own), "qid string, node_id string")


def test_walk(spark):
    graph = graph_of(spark, "abc", [("a", "b", 1), ("b", "c", 1)])
    got = pr.propagate(graph, seeds(spark, ("q", "a")), Parameters(2, 0.5, 3))
    assert rows(got, "rank", "node_id", "score") == [(1, "a", 1.125), (2, "b", 0.5), (3, "c", 0.125)]


def test_no_or_unknown_seed(spark):
    graph = graph_of(spark, "ab", [("a", "b", 1)])
    assert rows(pr.propagate(graph, seeds(spark, ("q", "x")), Parameters())) == []
    got = pr.propagate(graph, seeds(spark, ("q", "x"), ("q", "a"), ("q", "a")), Parameters(0, 0.0, 5))
    assert rows(got, "node_id", "score") == [("a", 1.0)]


def test_zero_decay_keeps_reached_nodes(spark):
    graph = graph_of(spark, "ab", [("a", "b", 1)])
    assert rows(pr.propagate(graph, seeds(spark, ("q", "a")), Parameters(1, 0.0, 5)), "node_id", "score") == [("a", 1.0), ("b", 0.0)]


def test_parallel_edges_sum_and_ties_go_by_id(spark):
    graph = graph_of(spark, ["a", "n2", "n10"], [("a", "n2", 1), ("a", "n10", 0.5), ("n10", "a", 0.5)])
    got = pr.propagate(graph, seeds(spark, ("q", "a")), Parameters(1, 1.0, 3))
    assert rows(got, "rank", "node_id") == [(1, "a"), (2, "n10"), (3, "n2")]


def test_parameters_by_question(spark):
    graph = graph_of(spark, "abc", [("a", "b", 1), ("b", "c", 1)])
    own = spark.createDataFrame([("1", 1, 0.5, 9), ("2", 2, 0.5, 1)], "qid string, depth int, decay double, top_k int")
    got = pr.propagate(graph, seeds(spark, ("1", "a"), ("2", "a")), own, max_depth=2)
    assert rows(got, "qid", "node_id", "score") == [("1", "a", 1.0), ("1", "b", 0.5), ("2", "a", 1.125)]


TREE = [("0", "1", 1), ("0", "2", 1), ("0", "3", 1), ("0", "4", 1), ("4", "5", 1)]


def test_biased_pairs(spark):
    graph = graph_of(spark, "012345", TREE)
    got = {(r["arm"], r["node_id"]): r["score"] for r in pr.propagate_biased(graph, seeds(spark, ("q", "5")), PAIRS, Parameters(2, 0.3, 10)).collect()}
    assert [got["C2", n] for n in "540"] == pytest.approx([0.7315, 0.21, 0.0315])
    assert [got["C6", n] for n in "540"] == pytest.approx([0.7315, 0.105, 0.007875])


def test_random_walk_arm_is_the_walk(spark):
    graph = graph_of(spark, "012345", TREE)
    walk = {r["node_id"]: r["score"] for r in pr.propagate(graph, seeds(spark, ("q", "5")), Parameters(3, 0.3, 10)).collect()}
    arm = {r["node_id"]: r["score"] for r in pr.propagate_biased(graph, seeds(spark, ("q", "5")), {"x": (0.0, 1.0)}, Parameters(3, 0.3, 10)).collect()}
    assert arm == pytest.approx({k: 0.7 * v for k, v in walk.items()})


def test_biased_checks(spark):
    with pytest.raises(ValueError):
        pr.biased_scores(graph_of(spark, "ab", [("a", "b", 1)]), seeds(spark, ("q", "a")), PAIRS, Parameters(1, 1.0))
    with pytest.raises(ValueError):
        pr.propagate_biased(graph_of(spark, "ab", [("a", "b", 2)]), seeds(spark, ("q", "a")), check=True)
    with pytest.raises(ValueError):
        pr.propagate_biased(graph_of(spark, "abc", [("a", "b", 1)]), seeds(spark, ("q", "a")), check=True, query_type="S")


def test_sampled_mode_keeps_the_mean(spark):
    ids = ["a"] + [f"b{i}" for i in range(400)]
    graph = graph_of(spark, ids, [("a", b, 1) for b in ids[1:]])
    own = seeds(spark, *[(f"q{i}", "a") for i in range(20)])
    got = pr.biased_scores(graph, own, {"x": (0.0, 1.0)}, Parameters(1, 0.5), epsilon=0.01).where("node_id <> 'a'").groupBy("qid").sum("score").collect()
    means = [r[1] for r in got]
    assert sum(means) / len(means) == pytest.approx(0.25, rel=0.1)


def test_each_question_walks_its_own_depth(spark):
    """A question leaves the frontier at its depth, and the plan has as many hops as the deepest asks for."""
    graph = graph_of(spark, "012345", TREE)
    own = seeds(spark, ("1", "5"), ("2", "1"), ("3", "5"))
    table = spark.createDataFrame([("1", 1, 0.5, 9), ("2", 2, 0.25, 9), ("3", 0, 0.9, 9)], "qid string, depth int, decay double, top_k int")
    got = pr.propagate(graph, own, table)
    for qid, depth, decay, top_k in (tuple(r) for r in table.collect()):
        alone = pr.propagate(graph, own.where(f"qid = '{qid}'"), Parameters(depth, decay, top_k))
        assert rows(got.where(f"qid = '{qid}'")) == rows(alone)
    masses = pr.hop_masses(graph, own, 2, table)
    assert rows(masses.groupBy("qid").agg({"hop": "max"})) == [("1", 1), ("2", 2), ("3", 0)]


def test_arms_together_are_the_arms_alone(spark):
    graph = graph_of(spark, "012345", TREE)
    own = seeds(spark, ("1", "5"), ("2", "1"), ("2", "4"))
    pairs = PAIRS | {"odd": (0.3, 0.9)}
    got = {(r["qid"], r["arm"], r["node_id"]): r["score"] for r in pr.biased_scores(graph, own, pairs, Parameters(3, 0.4)).collect()}
    degree = {r["id"]: r["degree"] for r in graph.degrees.collect()}
    edges = [tuple(r) for r in graph.adjacency.collect()]
    for arm, (a, b) in pairs.items():
        for qid, start in (("1", {"5": 1.0}), ("2", {"1": 0.5, "4": 0.5})):
            want, mass = {k: 0.6 * v for k, v in start.items()}, start
            for hop in (1, 2, 3):
                moved: dict = {}
                for u, v in edges:
                    if u in mass:
                        moved[v] = moved.get(v, 0) + mass[u] / (degree[u] ** b * degree[v] ** a)
                mass = moved
                for k, v in mass.items():
                    want[k] = want.get(k, 0) + 0.6 * 0.4**hop * v
            assert {k[2]: v for k, v in got.items() if k[:2] == (qid, arm)} == pytest.approx(want)


def test_direct_neighbours(spark):
    graph = graph_of(spark, "abcde", [("a", "c", 1), ("b", "c", 1), ("b", "c", 1), ("a", "d", 1), ("b", "e", 1), ("a", "b", 1)])
    own = seeds(spark, ("q", "a"), ("q", "b"), ("q", "missing"))
    assert rows(pr.direct_neighbours(graph, own), "rank", "node_id", "score") == [(1, "c", 2.0), (2, "d", 1.0), (3, "e", 1.0)]
    assert rows(pr.direct_neighbours(graph, own, top_k=2), "node_id") == [("c",), ("d",)]
    with pytest.raises(ValueError):
        pr.direct_neighbours(graph, own, top_k=0)


def test_grid_is_the_same_as_single_runs(spark):
    graph = graph_of(spark, "012345", TREE)
    own, labels = seeds(spark, ("1", "5"), ("2", "1")), seeds(spark, ("1", "4"), ("2", "0"), ("2", "3"))
    grid = {(r["depth"], r["decay"], r["top_k"]): r["f1"] for r in parameter_grid(graph, own, labels, (1, 2), (0.3,), (2, 3)).collect()}
    from wayfare.operators.metrics import retrieval_metrics

    for (depth, decay, top_k), f1 in grid.items():
        ranked = pr.propagate(graph, own, Parameters(depth, decay, top_k))
        assert f1 == pytest.approx(retrieval_metrics(own, ranked, labels).agg({"f1": "avg"}).first()[0])


def test_last_hop_of_large_frontiers(spark):
    """Where few of a frontier's nodes go first, the best keep their whole scores, and ranks are those of the whole last hop."""
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(120)]
    edges = [(f"n{int(120 * rng.random() ** 2)}", rng.choice(ids), rng.choice([0.5, 1, 3])) for _ in range(500)] + [("n0", i, 1) for i in ids[1::2]]
    graph = graph_of(spark, ids, edges)
    seeds = spark.createDataFrame([(f"q{i}", f"n{(i * 7 + k * 11) % 120}") for i in range(6) for k in range(2)], "qid string, node_id string")
    for depth, decay, top_k in ((3, 0.75, 10), (1, 0.9, 500)):
        def listed(scores):
            return sorted((r["qid"], r["rank"], r["node_id"], round(r["score"], 10)) for r in pr.ranked(scores, ["qid"], top_k, F.col("node_id").asc()).collect())

        before = pr.hop_masses(graph, seeds, depth - 1).select("*", F.lit(decay).alias("decay"), F.lit(top_k).alias("top_k"))
        want = listed(pr.hop_masses(graph, seeds, depth).groupBy("qid", "node_id").agg(F.sum(F.pow(F.lit(decay), "hop") * F.col("mass")).alias("score")))
        for most in (1, 8):
            assert listed(pr.deepest_scores(graph, before, depth, light=0, most=most)) == want
    table = spark.createDataFrame([("q0", 1, 0.4, 3), ("q2", 3, 0.75, 10), ("q4", 0, 0.5, 2)], "qid string, depth int, decay double, top_k int")
    got = {(r["qid"], r["rank"], r["node_id"]) for r in pr.propagate(graph, seeds, table, light=0).collect()}
    assert got == {(q, r["rank"], r["node_id"]) for q, *own in table.collect() for r in pr.propagate(graph, seeds.where(F.col("qid") == q), Parameters(*own)).collect()}


def test_questions_of_the_same_seeds_walk_once(spark):
    """Equal seeds, depth and decay are one walk, of which each question takes its own number of nodes; a hop's arcs are neither summed nor sorted."""
    graph = graph_of(spark, "abc", [("a", "b", 1.0), ("a", "b", 2.0), ("b", "c", 1.0)])
    own = seeds(spark, ("x", "a"), ("x", "b"), ("y", "b"), ("y", "a"), ("z", "a"))
    table = spark.createDataFrame([("x", 2, 0.5, 1), ("y", 2, 0.5, 3), ("z", 2, 0.5, 3)], "qid string, depth int, decay double, top_k int")
    asked, walks = pr.same_walks(own, table, ["qid"])
    assert sorted((r["qid"], r["walk"]) for r in asked.collect()) == [("x", "x"), ("y", "x"), ("z", "z")] and walks.count() == 2
    got = {(r["qid"], r["rank"]): (r["node_id"], r["score"]) for r in pr.propagate(graph, own, table).collect()}
    assert len(got) == 7 and got["x", 1] == got["y", 1]
    assert sum(score for (qid, _), (_, score) in got.items() if qid == "z") == pytest.approx(1.75)
    assert graph.arcs.count() == 6 and graph.transition.count() == 4


def test_only_nodes_that_can_be_among_the_best_are_ranked(spark):
    scores = spark.range(4000).select(F.concat(F.lit("q"), F.col("id") % 2).alias("qid"), F.col("id").cast("string").alias("node_id"), (F.floor(F.col("id") / 8) / 500).alias("score"))
    few = pr.leading(scores, ["qid"], 3)
    listed = lambda df: rows(pr.ranked(df, ["qid"], 3, F.col("node_id").asc()))
    assert listed(few) == listed(scores) and few.count() < 100
    assert pr.leading(scores.where("node_id < '2'"), ["qid", "node_id"], 3).count() == scores.where("node_id < '2'").count()


def test_questions_of_long_walks_are_columns(spark):
    """A hop has a row an arc for up to 16 questions, and all scores are those of each question alone; the setting of the written table is given back."""
    graph = graph_of(spark, "012345", TREE)
    own = seeds(spark, *[(f"q{i:02}", str(i % 6)) for i in range(20)], ("q03", "5"))
    names, starts = pr.together(pr.valid_seeds(graph, own), [], 16)
    assert sorted(r["count"] for r in names.groupBy("qid").count().collect()) == [4, 16] and starts.count() == 21
    got = rows(pr.propagate_biased(graph, own, {"x": (0.25, 0.75)}, Parameters(3, 0.4, 4)).withColumn("score", F.round("score", 12)), "qid", "rank", "node_id", "score")
    for qid in ("q00", "q03", "q19"):
        alone = pr.propagate_biased(graph, own.where(F.col("qid") == qid), {"x": (0.25, 0.75)}, Parameters(3, 0.4, 4)).withColumn("score", F.round("score", 12))
        assert [r for r in got if r[0] == qid] == rows(alone, "qid", "rank", "node_id", "score")
    cells = own.select("qid").distinct().crossJoin(spark.createDataFrame([(1, 0.5), (3, 0.75)], "depth int, decay double"))
    want = pr.hop_masses(graph, own, 3).join(cells, "qid").where("hop <= depth").groupBy("qid", "depth", "decay", "node_id").agg(F.sum(F.pow("decay", "hop") * F.col("mass")).alias("score"))
    same = lambda df: rows(df.withColumn("score", F.round("score", 12)), "qid", "depth", "decay", "node_id", "score")
    assert same(pr.weighted_best(graph, own, 3, cells, 50)) == same(want)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_scores_that_are_asked_for_are_those_of_all(spark):
    graph = graph_of(spark, "012345", TREE)
    own, few = seeds(spark, ("1", "5"), ("2", "1"), ("2", "4")), seeds(spark, ("1", "4"), ("2", "0"), ("2", "none"))
    for depth in (2, 3):
        for epsilon in (None, 0.05):
            score = lambda wanted: rows(pr.biased_scores(graph, own, PAIRS, Parameters(depth, 0.3, 10), epsilon=epsilon, wanted=wanted))  # noqa: E731, B023
            assert score(few) == [r for r in score(None) if (r[0], r[2]) in {("1", "4"), ("2", "0")}]


def test_biased_arcs_are_not_dealt_by_target(spark):
    graph = graph_of(spark, "012345", [*TREE, ("0", "0", 1)])
    near = {x: {b for a, b, *_ in TREE if a == x} | {a for a, b, *_ in TREE if b == x} for x in "012345"}
    assert rows(graph.biased) == sorted((a, b, len(near[a]), len(near[b])) for a in near for b in near[a])
    joins = [x for x in graph.biased._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and not any("dst#" in x for x in joins)
