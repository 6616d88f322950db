import random
from statistics import mean

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wayfare.operators import context as cx
from wayfare.operators import metrics as me
from wayfare.operators import selection as se
from wayfare.sources.graph import Graph


def small(spark, description=""):
    nodes = [("a", "Alpha", description), ("b", "Beta", "two"), ("c", "Gamma", "three")]
    return Graph.from_rows(spark, nodes, [("a", "b", 1.0, "first"), ("b", "a", 1.0, "first"), ("b", "c", 1.0, "second"), ("a", "a", 1.0, "loop")])


def ranks(spark, *own):
    return spark.createDataFrame([("q", i + 1, n, s) for i, (n, s) in enumerate(own)], "qid string, rank int, node_id string, score double")


def asked(spark):
    return spark.createDataFrame([("q",), ("none",)], "qid string")


def seeds(spark, *own):
    return spark.createDataFrame([("q", n) for n in own], "qid string, node_id string")


def test_context(spark):
    got = dict(rows(cx.context(small(spark), asked(spark), ranks(spark, ("b", 0.03015), ("a", 0.5)))))
    assert got["none"] == cx.NOTHING
    assert got["q"].split("\n") == ["Retrieved entities:", "- Beta [score=0.0301]: two", "- Alpha [score=0.5000]: ", "Retrieved relationships:", "- Alpha -> Beta: first", "- Beta -> Alpha: first", "- Alpha -> Alpha: loop"]


def test_study_context(spark):
    got = cx.study_context(small(spark), asked(spark), ranks(spark, ("b", 1.0)), seeds(spark, "a", "zz")).where("qid = 'q'").first()
    assert got["context"].split("\n") == ["Retrieved entities:", "- Beta: two", "Retrieved relationships:", "- Alpha -> Beta: first"]
    assert (got["context_node_ids"], got["context_truncated"], got["context_characters"]) == (["b"], False, len(got["context"]))


def test_caps(spark):
    nodes = [(f"n{i}", f"T{i}", "d" * 200) for i in range(4)]
    graph = Graph.from_rows(spark, nodes, [("n0", "n1", 1.0, "x" * 200), ("n1", "n0", 1.0, "short")])
    got = cx.study_context(graph, asked(spark), ranks(spark, *[(f"n{i}", 1.0) for i in range(4)]), seeds(spark), max_chars=512).where("qid = 'q'").first()
    assert got["context_node_ids"] == ["n0", "n1"] and got["context_truncated"] and got["context_characters"] <= 512
    assert got["context"].endswith("- T1 -> T0: short") and "xxx" not in got["context"]
    with pytest.raises(ValueError):
        cx.study_context(graph, asked(spark), ranks(spark, ("n0", 1.0)), seeds(spark), max_chars=100)
    with pytest.raises(ValueError, match="cannot fit"):
        cx.study_context(small(spark, "d" * 600), asked(spark), ranks(spark, ("a", 1.0)), seeds(spark), max_chars=512)
    with pytest.raises(ValueError, match="budget"):
        cx.study_context(graph, asked(spark), ranks(spark, *[(f"n{i % 4}", 1.0) for i in range(11)]), seeds(spark))


def test_retrieval_metrics(spark):
    got = me.retrieval_metrics(asked(spark), ranks(spark, ("a", 3.0), ("b", 2.0), ("c", 1.0), ("a", 0.5)), seeds(spark, "b", "d"))
    q = got.where("qid = 'q'").first()
    assert [q[c] for c in ("precision", "recall", "hit_rate", "reciprocal_rank")] == pytest.approx([1 / 3, 1 / 2, 1.0, 1 / 2])
    assert rows(got.where("qid = 'none'"), *me.METRICS) == [(0.0,) * 5]


def test_f1_denominators(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], [])], "p array<string>, r array<string>")
    got = [(r[0], r[1]) for r in df.select(me.set_f1(F.col("p"), F.col("r")), me.list_f1(F.col("p"), F.col("r"))).collect()]
    assert got[0] == pytest.approx((0.5, 2 * (1 / 3) * 0.5 / (1 / 3 + 0.5))) and got[1] == (0.0, 0.0)


def test_entity_metrics(spark):
    kind = "k int, mentioned array<string>, excluded array<string>, relevant array<string>, context_ids array<string>"
    own = [(1, ["a", "c"], [], ["a", "b"], ["a", "b"]), (2, ["s"], ["s"], ["a"], ["a"]), (3, ["a"], None, ["a"], None)]
    got = {r["k"]: r for r in me.entity_metrics(spark.createDataFrame(own, kind)).collect()}
    assert (got[1]["entity_f1"], got[1]["unsupported_node_ids"], got[1]["context_faithfulness"]) == (0.5, ["c"], 0.5)
    assert (got[2]["entity_f1"], got[2]["context_faithfulness"]) == (0.0, 1.0)
    assert (got[3]["entity_f1"], got[3]["context_faithfulness"]) == (1.0, None)


def test_mapping_and_outcome(spark):
    own = [(["a"], ["a"]), (["a", "x"], ["a", "b"]), ([], ["c"])]
    df = spark.createDataFrame(own, "predicted array<string>, expected array<string>")
    r = me.mapping_metrics(df).first()
    assert (r["true_positive"], r["false_positive"], r["false_negative"], r["exact_sets"]) == (2, 1, 2, 1) and r["f1"] == pytest.approx(4 / 7)
    assert [x[0] for x in df.select(me.mapping_outcome(F.col("predicted"), F.col("expected"))).collect()] == ["exact", "partial", "empty"]


def test_nulls_count_as_zero(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", None)], "condition string, f double")
    assert me.macro(df, ["condition"], ("f",)).first()["f"] == 0.5


def test_ratings(spark):
    good = spark.createDataFrame([("5", "1", " ok ")], "correctness string, completeness string, reason string")
    assert rows(me.valid_ratings(good)) == [(5, 1, "ok")]
    for bad in (("true", "1", "x"), ("3.0", "1", "x"), ("6", "1", "x"), ("1", "1", " "), (None, "1", "x")):
        with pytest.raises(Exception, match="invalid rating"):
            me.valid_ratings(spark.createDataFrame([bad], good.schema)).collect()


def scores(spark, *own):
    return spark.createDataFrame([(q, t, f"C{i + 2}", f) for q, t, values in own for i, f in enumerate(values)], "qid string, question_type string, arm string, f1 double")


def test_selector(spark):
    s = scores(spark, ("1", "direct", (0.1, 0.9, 0.2, 0.2, 0.2)), ("2", "path", (0.5, 0.5, 0.1, 0.1, 0.1)), ("3", "direct", (0.1, 0.8, 0.2, 0.2, 0.2)))
    assert rows(se.best_arm(s)) == [("C3",)]
    assert rows(se.train_selector(s)) == [("comparison", "C3"), ("direct", "C3"), ("path", "C2"), ("similarity", "C3")]
    with pytest.raises(ValueError):
        se.require_arms(s.where("arm <> 'C4'"))
    with pytest.raises(ValueError):
        se.require_arms(s.where("false"))


def test_leave_one_out_agrees_with_retraining(spark):
    rng = random.Random(4)
    data = [(str(i), ("direct", "path")[i % 2], tuple(rng.randrange(5) / 4 for _ in range(5))) for i in range(7)]
    got = {r["qid"]: r for r in se.leave_one_out(scores(spark, *data)).collect()}
    arms = ("C2", "C3", "C4", "C5", "C6")

    def best(own):
        return min(arms, key=lambda a: (-mean(r[2][arms.index(a)] for r in own), a))

    for q, kind, values in data:
        rest = [r for r in data if r[0] != q]
        typed = [r for r in rest if r[1] == kind] or rest
        assert (got[q]["selected_arm"], got[q]["global_arm"]) == (best(typed), best(rest))
        assert got[q]["selected_f1"] == values[arms.index(best(typed))]


@pytest.mark.parametrize("inner", [True, False])
def test_bootstrap_agrees_with_the_streams(spark, inner):
    d = {"x": [0.1, -0.2, 0.3], "y": [0.0, 0.5, 0.5]}
    df = spark.createDataFrame([(c, i, v) for c, own in d.items() for i, v in enumerate(own)], "condition string, position int, difference double")
    got = {r["condition"]: r for r in se.bootstrap(df, ["x", "y"], samples=100, seed=3, inner_index=inner).collect()}
    rng = random.Random(3)
    for c in ("x", "y"):
        rng = rng if inner else random.Random(3)
        boot = sorted(sum(d[c][rng.randrange(3)] for _ in d[c]) / 3 for _ in range(100))
        low, high = (int(0.025 * 99), int(0.975 * 99)) if inner else (int(100 * 0.025), int(100 * 0.975))
        assert (got[c]["ci95_lower"], got[c]["ci95_upper"]) == pytest.approx((boot[low], boot[high]))


def test_registered_bootstrap_of_all_resamples(spark, tmp_path):
    from wayfare import queries

    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(str(tmp_path / "nation.parquet"))
    got = {r["condition"]: r for r in queries.QUERIES["bootstrap_interval_whole"](spark, str(tmp_path)).collect()}
    rng = random.Random(90055)
    for k in (3, 4, 5, 6):
        d = [(i * 17 + k * k * 29) % 97 / 97 - (i * 17 + 4 * 29) % 97 / 97 for i in range(25)]
        boot = sorted(sum(d[rng.randrange(25)] for _ in d) / 25 for _ in range(10_000))
        own = got[f"C{k}"]
        assert (own["mean_difference"], own["ci95_lower"], own["ci95_upper"]) == pytest.approx((mean(d), boot[249], boot[9749]), abs=2e-9)


def test_selection_rows(spark):
    import hashlib

    q = spark.createDataFrame([(f"q{i}", "direct") for i in range(9)], "qid string, question_type string")
    want = min((f"q{i}" for i in range(9)), key=lambda v: hashlib.sha256(f"90055:{v}".encode()).digest())
    assert rows(se.hash_sample(q)) == [("direct", want)]
    grid = spark.createDataFrame([(2, 0.3, 10, 0.5, 0.9), (1, 0.3, 5, 0.5, 0.9), (1, 0.6, 5, 0.5, 0.8)], "depth int, decay double, top_k int, f1 double, recall double")
    assert se.best_parameters(grid).first()["top_k"] == 5
    maps = spark.createDataFrame([(1.0, 0.9, 0.8, 0.8, 0.1), (1.0, 0.9, 0.8, 0.85, 0.1), (0.9, 1.0, 1.0, 0.9, 0.1)], "precision double, f1 double, recall double, threshold double, margin double")
    assert se.best_mapping(maps).first()["threshold"] == 0.85


def test_graph_summary(spark):
    nodes = spark.createDataFrame([("0", "x"), ("1", "x"), ("2", "y")], "id string, category string")
    edges = spark.createDataFrame([("0", "1"), ("1", "0"), ("2", "2")], "a1 string, b1 string")
    row, kinds = me.graph_summary(nodes, edges, "a1", "b1", "category")
    r = row.first()
    assert (r["nodes"], r["edges"], r["self_loops"], r["duplicates"], r["isolated"]) == (3, 1, 1, 1, 1) and rows(kinds) == [("x", 2), ("y", 1)]
