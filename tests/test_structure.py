"""Whole-graph structure and joins along time, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from test_graph import graph_of

from wayfare.operators import structure, temporal
from wayfare.sources.graph import Graph


def random_graph(spark, seed, n=40, m=45):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    edges = [(rng.choice(ids[:-5]), rng.choice(ids[:-5])) for _ in range(m)]
    near = {i: set() for i in ids}
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    return graph_of(spark, ids, [(a, b, 1) for a, b in edges]), ids, near, edges


def reached(near, starts):
    level = {s: 0 for s in starts}
    last = list(level)
    while last:
        last = [y for x in last for y in near[x] if y not in level and level.setdefault(y, level[x] + 1)]
    return level


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels(spark, seed):
    graph, ids, near, _ = random_graph(spark, seed)
    assert rows(structure.components(graph)) == sorted((i, min(reached(near, [i]))) for i in ids)
    seeds = spark.createDataFrame([("x", "n1"), ("x", "n2"), ("x", "n2"), ("y", "n39"), ("z", "nowhere")], "qid string, node_id string")
    want = [("x", k, v) for k, v in reached(near, ["n1", "n2"]).items()] + [("y", "n39", 0)]
    assert sorted(map(tuple, structure.levels(graph, seeds).collect())) == sorted(want)
    assert sorted(map(tuple, structure.levels(graph, seeds, 1).collect())) == sorted(w for w in want if w[2] <= 1)


def test_components_of_a_long_path(spark):
    ids = [f"{i:03d}" for i in range(300)]
    graph = graph_of(spark, ids, [(a, b, 1) for a, b in zip(ids[1:], ids)])
    assert {r["component"] for r in structure.components(graph).collect()} == {"000"}


def test_pagerank(spark):
    graph, ids, _, edges = random_graph(spark, 3)
    weight = {i: {} for i in ids}
    for a, b in edges:
        if a != b:
            weight[a][b] = weight[a].get(b, 0) + 1
            weight[b][a] = weight[b].get(a, 0) + 1
    ranks = {i: 1 / len(ids) for i in ids}
    for _ in range(200):
        held = sum(r for i, r in ranks.items() if not weight[i])
        new = {i: 0.5 / len(ids) + 0.5 * held / len(ids) for i in ids}
        for i, out in weight.items():
            for j, w in out.items():
                new[j] += 0.5 * ranks[i] * w / sum(out.values())
        ranks = new
    got = {r["id"]: r["rank"] for r in structure.pagerank(graph, 0.5, 1e-6).collect()}
    assert got == pytest.approx(ranks, abs=2e-6) and sum(got.values()) == pytest.approx(1)
    with pytest.raises(RuntimeError, match="still moves"):
        structure.pagerank(graph, 0.9, 1e-12, rounds=2)
    with pytest.raises(ValueError):
        structure.pagerank(graph, 1.5)


def test_triangles(spark):
    graph, ids, near, _ = random_graph(spark, 4, 20, 60)
    want = []
    for i in ids:
        t = sum(1 for x in near[i] for y in near[i] if x < y and y in near[x])
        d = len(near[i])
        if d:
            want.append((i, d, t, 2 * t / (d * (d - 1)) if d > 1 else 0.0))
    assert rows(structure.triangles(graph)) == sorted(want)


def test_neighbourhood_sizes(spark):
    """Small ones exactly; a hub with two thousand others around it, two hops wide for all of them, within four standard errors."""
    graph, ids, near, _ = random_graph(spark, 6)
    level = {i: reached(near, [i]) for i in ids}
    want = [(i, hop, sum(1 for v in level[i].values() if v <= hop)) for i in ids for hop in (1, 2, 3)]
    assert rows(structure.neighbourhood_sizes(graph, 3)) == sorted(want)
    few = spark.createDataFrame([(i,) for i in ids[::3]], "id string")
    assert rows(structure.neighbourhood_sizes(graph, 3, last=few)) == sorted(x for x in want if x[1] < 3 or x[0] in ids[::3])
    star = ["hub", *[f"{i:04d}" for i in range(2000)], "alone"]
    graph = graph_of(spark, star, [("hub", i, 1) for i in star[1:-1]] * 2)
    got = {(r["id"], r["hop"]): r["nodes"] for r in structure.neighbourhood_sizes(graph, precision=11).collect()}
    assert len(got) == 2 * len(star) and got["alone", 2] == 1 and got["0007", 1] == 2
    assert all(abs(got[i, 2] - 2001) <= 4 * 1.04 / 2**5.5 * 2001 for i in star[:-1])
    for wrong in ({"hops": 0}, {"precision": 3}):
        with pytest.raises(ValueError):
            structure.neighbourhood_sizes(graph, **wrong)


def test_structure_of_nothing(spark):
    graph = Graph.from_rows(spark, [], [])
    assert rows(structure.components(graph)) == rows(structure.triangles(graph)) == rows(structure.pagerank(graph)) == []
    assert rows(structure.levels(graph, spark.createDataFrame([("q", "a")], "qid string, node_id string"))) == []
    assert rows(structure.neighbourhood_sizes(graph)) == []
    alone = graph_of(spark, "ab", [])
    assert rows(structure.components(alone)) == [("a", "a"), ("b", "b")] and rows(structure.pagerank(alone)) == [("a", 0.5), ("b", 0.5)]


KIND = "k string, t timestamp, v int"


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("bucket", [1, 7, 86_400])
def test_as_of(spark, strict, bucket):
    rng, start = random.Random(5), datetime(1969, 12, 31, 23, 59, 40)
    moment = lambda: start + timedelta(seconds=rng.randrange(60))
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([moment(), moment(), None]), i) for i in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.choice([moment(), moment(), None]), rng.choice([1, 2, None])) for i in range(40)]
    order = lambda v: (v is not None, v)
    want = []
    for k, t, v in left:
        own = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        want.append((k, t, v, max(own, key=lambda r: (r[1], *order(r[2])))[2] if own else None))
    got = temporal.as_of(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND).withColumnRenamed("v", "w"), "k", "t", ["w"], strict=strict, bucket_seconds=bucket)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bucket", [1, 13, 86_400])
def test_in_intervals(spark, bucket):
    rng, start = random.Random(6), datetime(1970, 1, 1)
    moment = lambda: rng.choice([start + timedelta(seconds=rng.randrange(-30, 60)), None])
    points = [(rng.choice(["a", "b", None]), moment(), i) for i in range(50)]
    spans = [(rng.choice(["a", "b", None]), moment(), moment(), i) for i in range(50)]
    want = [(p, s) for k, t, p in points for x, b, e, s in spans if None not in (k, t, x, b, e) and k == x and b <= t < e]
    df = temporal.in_intervals(spark.createDataFrame(points, "k string, t timestamp, p int"), spark.createDataFrame(spans, "k string, b timestamp, e timestamp, s int"), "k", "t", "b", "e", bucket_seconds=bucket)
    assert sorted((r["p"], r["s"]) for r in df.collect()) == sorted(want)
    with pytest.raises(ValueError, match="both sides"):
        temporal.in_intervals(df.select("k", "t", "p"), df.select("k", "b", "e", "p"), "k", "t", "b", "e")


def test_streamed_sessions(spark, tmp_path):
    """Late rows before the watermark are dropped, others join their session; what is open at the end waits."""
    from wayfare.streaming.sessions import event_stream, session_stream, sessions

    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    files = [[("a", at(0), 1.0), ("a", at(9), 2.0), ("b", at(5), 4.0)], [("a", at(4), 8.0), ("a", at(60), 16.0)], [("a", at(55), 32.0), (None, at(2), 1.0)], [("b", at(200), 64.0), ("b", at(1), 99.0)]]
    for own in files:
        spark.createDataFrame(own, "u string, t timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "u string, t timestamp, v double"
    stream = event_stream(spark, str(tmp_path / "in"), schema)
    session_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"), "u", "t", "v", gap="10 minutes", late="20 minutes").awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", at(0), at(19), 3, 11.0), ("a", at(55), at(70), 2, 48.0), ("b", at(5), at(15), 1, 4.0)]
    table = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in sessions(table, "u", "t", "v", gap="10 minutes").collect()) == [("a", at(0), at(19), 3, 11.0), ("a", at(55), at(70), 2, 48.0), ("b", at(1), at(15), 2, 103.0), ("b", at(200), at(210), 1, 64.0)]


def test_components_rounds_keep_no_plans(spark):
    """What a checkpoint knows of its rows doubled from round to round, until planning took all the time."""
    ids = [f"v{i:02d}" for i in range(40)]
    graph = Graph.from_rows(spark, [(i, i, "") for i in ids], [(a, b, 1.0, "") for a, b in zip(ids, ids[1:]) if b != "v20"])
    found = structure.components(graph.keep("adjacency"))
    graph.release()
    assert {tuple(r) for r in found.collect()} == {(i, "v00" if i < "v20" else "v20") for i in ids}
    # the nodes are rows of the session; all else comes of files
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_levels_of_more_questions_than_a_word(spark, monkeypatch):
    """Questions go together as bits, a word's at a time, and nodes that a level reaches from several of them are one row."""
    monkeypatch.setattr(structure, "BITS", 3)
    graph = graph_of(spark, "abcde", [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    own = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate("abcdea")], "qid string, node_id string")
    path = {x: {y: abs("abcd".index(x) - "abcd".index(y)) for y in "abcd"} for x in "abcd"} | {"e": {"e": 0}}
    want = sorted((f"q{i}", y, n) for i, x in enumerate("abcdea") for y, n in path[x].items())
    assert sorted((r["qid"], r["node_id"], r["level"]) for r in structure.levels(graph, own).collect()) == want
