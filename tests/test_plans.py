import json

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_graph import graph_of

from wayfare import cli
from wayfare.operators.propagation import propagate_biased
from wayfare.plans import experiment, prepare, strategies, study
from wayfare.schema import PAIRS, BiasConfig, Parameters
from wayfare.sources import files
from wayfare.sources.cut import kept
from wayfare.sources.graph import Graph
from wayfare.sources.language_model import LOG_FIELDS, Http, Replay, cache_key, parsed
from wayfare.sources.model_calls import Calls, answers
from wayfare.streaming.questions import answer_stream, question_stream


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(x, t, "") for x, t in zip("abcde", ("Alpha", "Beta", "Gamma", "Delta", "Epsilon"))]
    return Graph.from_rows(spark, nodes, [(a, b, 1.0, "links") for a, b in ("ab", "bc", "cd", "ae")]).keep("transition", "titles")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")


def nodes_of(run):
    return {(r["qid"], r["node_id"]): r["score"] for r in run.ranked.collect()}


def test_rules_and_fixed(spark, graph):
    q = asked(spark, "What is Alpha?", "How does Alpha connect to Delta?")
    got = strategies.run(graph, q, "rules")
    assert rows(got.plan.parameters, "qid", "depth", "decay") == [("q0", 1, 0.4), ("q1", 3, 0.75)]
    assert rows(got.seeds, "qid", "node_id") == [("q0", "a"), ("q1", "a"), ("q1", "d")]
    assert ("q1", "c") in nodes_of(got) and ("q0", "c") not in nodes_of(got)
    fixed = strategies.run(graph, q, "fixed", fixed=Parameters(1, 0.3, 2))
    assert nodes_of(fixed)["q0", "b"] == pytest.approx(0.15)
    only = strategies.run(graph, q, "seed-only")
    assert set(nodes_of(only)) == {("q0", "a"), ("q1", "a"), ("q1", "d")}


def test_results_and_answers(spark, graph):
    q = asked(spark, "What is Alpha?", "nothing Nowhere")
    done = strategies.run(graph, q, "rules", match_mode="approximate")
    got = {r["qid"]: r for r in strategies.answered(strategies.results(graph, q, "rules", done), None).collect()}
    assert got["q0"]["matched_seed_ids"] == ["a"] and got["q0"]["ranked_nodes"][0]["title"] == "Alpha" and got["q0"]["answer"] == strategies.NO_ANSWER
    assert got["q1"]["matched_seed_ids"] == [] and got["q1"]["unmatched_keywords"] == ["nothing", "Nowhere"]
    assert got["q1"]["context"] == "No graph evidence was retrieved."


def test_models(spark, graph):
    q = asked(spark, "What is Alpha?")
    reply = Replay({"What is Alpha?": {"keywords": [" Alpha ", ""], "depth": 2, "decay": 0.5, "top_k": 5}})
    for strategy in ("llm", "llm-keywords", "llm-parameters", "llm-parameters-few-shot"):
        got = strategies.run(graph, q, strategy, client=reply)
        assert rows(got.plan.keywords, "keyword") == [("Alpha",)]
        with pytest.raises(RuntimeError):
            strategies.run(graph, q, strategy)
    with pytest.raises(ValueError):
        strategies.run(graph, q, "llm", client=Replay({"What is Alpha?": {"depth": 2, "decay": 0.5, "top_k": 7}}))
    with pytest.raises(ValueError):
        strategies.run(graph, q, "llm-keywords", client=Replay({"What is Alpha?": {"keywords": []}}))
    with pytest.raises(ValueError):
        strategies.run(graph, q, "other")
    with pytest.raises(ValueError):
        strategies.run(graph, q, "rules", match_mode="other")


def test_biased_backend(spark, graph):
    got = strategies.run(graph, asked(spark, "What is Alpha?"), "fixed", fixed=Parameters(1, 0.5, 9), backend=BiasConfig(query_type="N"))
    assert nodes_of(got) == pytest.approx({("q0", "a"): 0.5, ("q0", "b"): 0.125, ("q0", "e"): 0.125})


def test_backend_of_many_parameters(spark, graph):
    """One plan for all questions' parameters gives what each alone would."""
    seeds = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "d"), ("z", "b"), ("none", "zz")], "qid string, node_id string")
    cells = {"x": Parameters(0, 0.2, 3), "y": Parameters(3, 0.5, 2), "z": Parameters(2, 0.0, 9)}
    table = spark.createDataFrame([(q, p.depth, p.decay, p.top_k) for q, p in cells.items()], "qid string, depth int, decay double, top_k int")
    for backend in (None, BiasConfig(0.5, 0.5, delta=0.3, relative_error=0.9), BiasConfig(query_type="N")):
        got = propagate_biased(graph, seeds, PAIRS, table, backend=backend)
        want = [r for q, p in cells.items() for r in rows(propagate_biased(graph, seeds.where(F.col("qid") == q), PAIRS, p, backend=backend))]
        assert sorted((*r[:4], round(r[4], 12)) for r in rows(got)) == sorted((*r[:4], round(r[4], 12)) for r in want)
    with pytest.raises(ValueError):
        propagate_biased(graph, seeds, PAIRS, table.withColumn("decay", F.lit(1.0)))


def test_experiment(spark, graph, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": "1", "question": "What is Alpha?", "question_type": "direct", "relevant_node_ids": ["b", "e"]}, {"id": "2", "question": "What is Beta?", "question_type": "direct", "relevant_node_ids": ["a", "c"]}]))
    q = files.read_questions(spark, str(path))
    conditions = [x for x in experiment.FROZEN if not x[0].startswith("llm")]
    got = experiment.compare(graph, q, tuple(conditions))
    assert got.count() == 8
    means = {r["condition"]: r["recall"] for r in experiment.summary(got).where("overall = 1").collect()}
    assert means["seed-only"] == 0.0 and means["rules"] == 1.0
    ci = {r["condition"]: r for r in experiment.intervals(got, [x[0] for x in conditions], samples=50).collect()}
    assert set(ci) == {"seed-only", "fixed-k5", "fixed-k10"} and ci["seed-only"]["mean_difference"] < 0
    seeds = spark.createDataFrame([("1", ["a"]), ("2", ["b"])], "id string, seed_node_ids array<string>")
    words = spark.createDataFrame([("1", 0, "Alphaa"), ("2", 0, "Beta")], "qid string, position int, keyword string")
    grid = {(r["threshold"], r["margin"]): r["recall"] for r in experiment.mapping_grid(graph, seeds, words, (0.8, 1.0), (0.1,)).collect()}
    assert grid == {(0.8, 0.1): 1.0, (1.0, 0.1): 0.5}


def test_study(spark, graph):
    arms = dict(direct="C3", comparison="C2", path="C2", similarity="C4")
    q = asked(spark, "Which pages directly neighbor Alpha", "Tell me of Beta")
    words = spark.createDataFrame([("q0", 0, "Alpha"), ("q1", 0, "Beta")], "qid string, position int, keyword string")
    rows_ = study.contexts(graph, q, words, arms, "C5", max_chars=512).cache()
    got = {(r["qid"], r["condition"]): r for r in rows_.collect()}
    assert len(got) == 16 and got["q0", "C0"]["context"] == ""
    assert (got["q0", "C7"]["reused_from"], got["q1", "C7"]["reused_from"]) == ("C3", "C5")
    assert got["q0", "C7"]["context"] == got["q0", "C3"]["context"] and got["q0", "C1"]["ranked_node_ids"] == ["b", "e"]
    choices = study.model_choices(q, Replay({r["question"]: {"arm": "C6"} for r in q.collect()}))
    nine = study.add_model_arm(rows_, choices)
    assert nine.where("condition = 'C8' and reused_from = 'C6'").count() == 2
    with pytest.raises(ValueError):
        study.model_choices(q, Replay({r["question"]: {"arm": "C1"} for r in q.collect()}))

    class Echo:
        def complete(self, system, user, **_):
            return "Beta and Gamma" if "Alpha" in user.split("\n")[0] else "nothing"

    given = study.arm_answers(q, nine, Echo())
    assert given.count() == 18
    labels = spark.createDataFrame([("q0", ["a"], ["b", "e"]), ("q1", ["b"], ["a", "c"])], "qid string, seed_node_ids array<string>, relevant_node_ids array<string>")
    m = {(r["qid"], r["condition"]): r for r in study.answer_metrics(graph, given, nine, labels).collect()}
    assert m["q0", "C0"]["entity_f1"] == 0.5 and m["q0", "C0"]["context_faithfulness"] is None
    assert m["q0", "C1"]["unsupported_node_ids"] == ["c"] and m["q0", "C1"]["context_faithfulness"] == 0.5
    assert m["q1", "C1"]["context_faithfulness"] == 1.0
    blind = study.blind_cases(given.where("condition in ('C0', 'C1')"), 7, ("C0", "C1"))
    assert rows(blind, "qid", "label") == [("q0", "A"), ("q0", "B"), ("q1", "A"), ("q1", "B")]


def test_convert(spark):
    targets = spark.createDataFrame([("0", "x", "k"), ("1", "X", "k"), ("2", "z", "l")], "id string, page_name string, page_type string")
    edges = spark.createDataFrame([("0", "1"), ("1", "0"), ("2", "2"), ("1", "2")], "id_1 string, id_2 string")
    counts = spark.createDataFrame([("0", 2), ("1", 0), ("2", 5)], "id string, n_features int")
    nodes, out = prepare.convert(prepare.RAW["pages"], targets, edges, counts)
    assert rows(nodes, "id", "title") == [("fb_0", "x [page 0]"), ("fb_1", "X"), ("fb_2", "z")]
    assert rows(out, "source", "target") == [("fb_0", "fb_1"), ("fb_1", "fb_2")]
    config = prepare.RAW["developers"]
    named = targets.withColumnsRenamed({"page_name": "name", "page_type": "ml_target"})
    with pytest.raises(ValueError, match="unique"):
        prepare.convert(config, named, edges)
    with pytest.raises(ValueError, match="unknown ids"):
        prepare.convert(config, named, spark.createDataFrame([("0", "9")], "id_1 string, id_2 string"))
    with pytest.raises(ValueError, match="numbers"):
        prepare.convert(config, named.union(named.limit(1).withColumn("id", F.lit("x"))), edges)


def test_generate(spark):
    ids = [f"fb_{i}" for i in range(40)]
    ring = [(ids[i], ids[(i + k) % 40], 1) for i in range(40) for k in (1, 7)]
    graph = graph_of(spark, ids, ring, {x: f"Title {x}" for x in ids})
    kinds = spark.createDataFrame([(x, "k") for x in ids], "id string, category string")
    q = kept(prepare.generate(graph, kinds, 1, seed=1))
    own = q.select(F.col("id").alias("qid"), "question_type", F.col("seed_node_ids").alias("seeds"), F.col("relevant_node_ids").alias("relevant"))
    from wayfare.operators.topology import label_faults

    assert rows(label_faults(graph, own, kinds, ordered_paths=True)) == [] and q.count() == 4
    more = prepare.generate(graph, kinds, 1, name="b", used=prepare.used_seeds(q), seed=1)
    prepare.require_disjoint(q, more)
    with pytest.raises(ValueError):
        prepare.require_disjoint(q, q)
    with pytest.raises(RuntimeError, match="created only"):
        prepare.generate(graph, kinds, 30)
    # slices of starts and the number of those decided first change nothing
    assert rows(prepare.path_walks(graph, 1, starts=7)) == rows(prepare.path_walks(graph, 1))
    assert rows(prepare.path_walks(graph, 1, 9, starts=7)) == rows(prepare.path_walks(graph, 1).orderBy("at").limit(9))
    assert rows(prepare.generate(graph, kinds, 1, seed=1, first=1)) == rows(q)
    again = prepare.rephrase_paths(q, graph, "pages", "links")
    assert again.where("question like 'To get from%'").count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_first_disjoint_is_the_sequential_choice(spark, seed):
    import random

    from wayfare.operators.selection import first_disjoint

    rng = random.Random(seed)
    own = {(rng.randrange(40), tuple(sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.choice([1, 2, 2, 3]))))) for _ in range(60)}
    want, used = [], set()
    for at, seeds in sorted(own):
        if used.isdisjoint(seeds):
            used.update(seeds)
            want.append((at, list(seeds)))
    df = spark.createDataFrame([(at, list(x)) for at, x in own], "at int, seeds array<string>")
    for n in (1, 5, 100):
        assert [tuple(r) for r in first_disjoint(df.union(df), n).orderBy("at", "seeds").collect()] == want[:n]
    assert first_disjoint(df.where("false"), 3).collect() == []


def test_files(spark, tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nexport A='x y'\nB=2\n\n")
    assert files.read_env_file(env) == {"A": "x y", "B": "2"}
    monkeypatch.setenv("B", "shell")
    assert files.setting("B", {"B": "2"}) == "shell"
    f = tmp_path / "f.txt"
    f.write_bytes(b"abc")
    digests = files.file_digests(spark, [str(f)])
    assert digests.first()["sha256"].startswith("ba7816bf")
    assert rows(prepare.protocol_faults({"frozen_files": {"f.txt": digests.first()["sha256"]}}, digests, str(tmp_path))) == []
    assert prepare.protocol_faults({"frozen_files": {"f.txt": "0", "g": "1"}}, digests, str(tmp_path)).count() == 2
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    files.write_bundle({"t": df}, {"manifest": {"n": 1}}, str(tmp_path / "bundle"))
    assert json.loads((tmp_path / "bundle/manifest.json").read_text()) == {"n": 1} and spark.read.json(str(tmp_path / "bundle/t")).count() == 1
    with pytest.raises(FileExistsError):
        files.write_bundle({}, {}, str(tmp_path / "bundle"))
    files.write_jsonl(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="exists"):
        files.write_jsonl(df, str(tmp_path / "j"), overwrite=False)
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    (tmp_path / "k.jsonl").write_text('{"example_id": "1", "keywords": ["a"]}\n{"example_id": "1", "keywords": []}\n')
    with pytest.raises(ValueError, match="duplicate"):
        files.read_saved_keywords(spark, str(tmp_path / "k.jsonl"))
    (tmp_path / "features.json").write_text('{"0": [1, 2], "1": []}')
    assert rows(files.read_feature_counts(spark, str(tmp_path / "features.json"))) == [("0", 2), ("1", 0)]
    left = spark.createDataFrame([("1", "q")], "example_id string, question string")
    with pytest.raises(ValueError):
        files.aligned(left, left.withColumn("question", F.lit("other")))


def test_contexts_file(spark, tmp_path):
    def row(**change):
        conditions = {c: {"ranked_node_ids": [c], "context": "" if c == "C0" else c, "reused_from": None} for c in ("C0", "C1", *PAIRS)}
        conditions["C7"] = dict(conditions["C3"], reused_from="C3")
        for k, v in change.items():
            conditions[k].update(v)
        return json.dumps({"example_id": "1", "question": "q", "conditions": conditions})

    path = tmp_path / "c.jsonl"
    path.write_text(row())
    assert files.read_contexts(spark, str(path)).count() == 1
    for change in ({"C0": {"context": "x"}}, {"C7": {"context": "x"}}, {"C7": {"reused_from": "C1"}}):
        path.write_text(row(**change))
        with pytest.raises(ValueError):
            files.read_contexts(spark, str(path))


def test_cache_and_log(tmp_path):
    client = Http("http://x/", "m", "secret-key", cache_dir=str(tmp_path / "cache"), log_path=str(tmp_path / "log.jsonl"))
    key = cache_key("http://x", "m", "sys", "the prompt", True)
    client.responses[key] = {"content": '{"a": 1}', "usage": {"total_tokens": 3}, "finish_reason": "stop"}
    assert parsed(client, "sys", "the prompt") == {"a": 1} and client.last_call["cache_hit"]
    log = (tmp_path / "log.jsonl").read_text()
    assert "the prompt" not in log and "secret-key" not in log
    (tmp_path / f"cache/{key}.json").write_text("broken")
    assert key not in client.responses
    assert key != cache_key("http://x", "m", "sys", "the prompt", True, 5)
    with pytest.raises(ValueError):
        client.complete("s", "u", max_tokens=True)


def counted(folder):
    """Answers with the question in capitals, notes every call in a file, and fails for one question while a file is there."""

    class Counted:  # not of this module by name, as workers can't import it
        base_url, model = "http://x", "m"

        def complete(self, system, user, *, json_mode=False, max_tokens=None):
            import os

            with open(f"{folder}/calls", "a") as out:
                print(user, file=out)
            if user == "q3" and os.path.exists(f"{folder}/broken"):
                raise OSError("no route")
            return f"{system} {user.upper()} {json_mode} {max_tokens}"

    return Counted()


def test_calls_go_through_the_table(spark, tmp_path):
    """Two runs call each request once, whatever rows repeat it; a failed call raises, keeps the others and is made again."""
    calls = Calls(counted(str(tmp_path)), str(tmp_path / "responses"), str(tmp_path / "log"), concurrency=2, per_task=2)
    requests = spark.createDataFrame([(i, "s", f"q{i % 9}", i % 9 == 0, 5 if i % 9 == 1 else None) for i in range(30)], "content_id int, system string, user string, json_mode boolean, max_tokens int")
    made = lambda: (tmp_path / "calls").read_text().split()
    (tmp_path / "broken").touch()
    with pytest.raises(RuntimeError, match="1 calls failed: OSError: no route"):
        answers(requests, calls)
    assert made().count("q3") == 1
    (tmp_path / "broken").unlink()
    before = set(made()) - {"q3"}
    got = {(r["content_id"], r["user"]): r["content"] for r in answers(requests, calls).collect()}
    assert got == {(i, f"q{i % 9}"): f"s Q{i % 9} {i % 9 == 0} {5 if i % 9 == 1 else None}" for i in range(30)}
    assert sorted(made()) == sorted([*(f"q{i}" for i in range(9)), "q3"]) and before
    assert answers(requests, calls).count() == 30 and len(made()) == 10
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert set(log[0].asDict()) == set(LOG_FIELDS)
    assert sum(r["network_request"] for r in log) == 10 and sum(r["status"] == "failed" for r in log) == 1
    assert sum(r["cache_hit"] for r in log) == len(before) + 9
    key = cache_key("http://x", "m", "s", "q1", False, 5)
    assert {r["cache_key"] for r in log if r["max_tokens"] == 5} == {key}
    # a damaged file is a miss, other options are another request
    for path in (tmp_path / "responses").glob("*.parquet"):
        path.write_bytes(b"damaged")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert answers(requests.where("content_id = 0"), calls).first()["content"] == "s Q0 True None" and len(made()) == 11
    assert answers(requests.select("content_id", "system", "user").where("content_id = 0"), calls).first()["content"] == "s Q0 False None" and len(made()) == 12
    assert answers(requests.where("false"), calls).collect() == []
    with pytest.raises(ValueError):
        Calls(calls.client, concurrency=0)


def test_failed_calls_are_logged(tmp_path, monkeypatch):
    import io
    import urllib.error
    import urllib.request

    def refuse(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 429, "slow down", {}, io.BytesIO(b"too many"))

    monkeypatch.setattr(urllib.request, "urlopen", refuse)
    client = Http("http://x/", "m", "secret-key", cache_dir=str(tmp_path / "cache"), log_path=str(tmp_path / "log.jsonl"))
    with pytest.raises(RuntimeError, match="429.*too many"):
        client.complete("s", "u")
    line = json.loads((tmp_path / "log.jsonl").read_text())
    assert line["status"] == "http_error_429" and line["network_request"] and not line["cache_hit"] and not list(client.responses)
    reply = {"choices": [{"message": {"content": "yes"}, "finish_reason": "stop"}], "usage": {"total_tokens": 7}}
    monkeypatch.setattr(urllib.request, "urlopen", lambda request, timeout: io.BytesIO(json.dumps(reply).encode()))
    assert client.complete("s", "u") == client.complete("s", "u") == "yes"
    assert client.last_call["cache_hit"] and client.last_call["total_tokens"] == 7 and len(client.responses) == 1


def test_cli_and_stream(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    (tmp_path / "n.csv").write_text("id,title\na,Alpha\nb,Beta\n")
    (tmp_path / "e.csv").write_text("source,target\na,b\n")
    base = ["--nodes", str(tmp_path / "n.csv"), "--edges", str(tmp_path / "e.csv")]
    got = cli.main([*base, "ask", "What is Alpha?"], spark)
    assert got[0]["matched_seed_ids"] == ["a"] and got[0]["answer"] == strategies.NO_ANSWER
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "Alpha?", "question_type": "direct", "relevant_node_ids": ["b"]}]))
    got = cli.main([*base, "experiment", "--questions", str(tmp_path / "q.json"), "--output", str(tmp_path / "out"), "--strategies", "rules"], spark)
    assert got[0]["recall"] == 1.0
    with pytest.raises(ValueError):
        cli.main([*base, "ask", "x", "--depth", "6"], spark)
    sampled = ["--backend", "biased", "--bias-delta", "0.001", "--bias-relative-error", "0.05"]
    got = cli.main([*base, *sampled, "experiment", "--questions", str(tmp_path / "q.json"), "--output", str(tmp_path / "out"), "--strategies", "rules"], spark)
    assert got[0]["recall"] == 1.0
    with pytest.raises(ValueError):
        cli.main([*base, "--backend", "biased", "--bias-relative-error", "0", "ask", "x"], spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": "s1", "question": "What is Beta?"}\n')
    graph = Graph.from_csv(spark, base[1], base[3])
    stream = answer_stream(graph, question_stream(spark, str(tmp_path / "in")), str(tmp_path / "answers"), str(tmp_path / "check"))
    stream.awaitTermination(120)
    assert [r["matched_seed_ids"] for r in spark.read.json(str(tmp_path / "answers/batch=0")).collect()] == [["b"]]


def test_frozen_and_tune(spark, graph, tmp_path):
    kind = "id string, question string, question_type string, relevant_node_ids array<string>"
    q = spark.createDataFrame([("1", "What is Alpha?", "direct", ["b", "e"]), ("2", "What is Beta?", "direct", ["a", "c"])], kind)
    conditions = tuple(x for x in experiment.FROZEN if not x[0].startswith("llm"))
    got = experiment.frozen(graph, q, str(tmp_path / "f"), conditions=conditions, samples=20)
    assert set(got) == {"results", "summary", "intervals"} and json.loads((tmp_path / "f/manifest.json").read_text())["questions"] == 2
    with pytest.raises(FileExistsError):
        experiment.frozen(graph, q, str(tmp_path / "f"), conditions=conditions)
    rows_, best = experiment.tune(graph, q, depths=(0, 1), decays=(0.5,), tops=(3, 10))
    assert rows_.count() == 4 and best.first()["depth"] == 1


def test_study_reports(spark, graph):
    kind = "qid string, question string, question_type string, seed_node_ids array<string>, relevant_node_ids array<string>"
    q = spark.createDataFrame([("q0", "Which pages directly neighbor Alpha", "direct", ["a"], ["b", "e"]), ("q1", "Which pages directly neighbor Beta", "direct", ["b"], ["a", "c"])], kind)
    words = spark.createDataFrame([("q0", 0, "Alpha"), ("q1", 0, "Beta")], "qid string, position int, keyword string")
    s = study.arm_scores(graph, q, words).cache()
    assert s.count() == 10 and set(study.tune_selector(s)) == {"selector", "decisions", "oracle"}
    choices = spark.createDataFrame([("q0", "C2"), ("q1", "C6")], "qid string, arm string")
    report = study.model_selector_report(s, choices).first()
    assert report["selected_mean_f1"] <= report["oracle_mean_f1"]
    arms = dict(direct="C3", comparison="C2", path="C2", similarity="C4")
    made = study.contexts(graph, q.select("qid", "question"), words, arms, "C5")
    matched = spark.createDataFrame([("q0", ["a"])], "qid string, matched_seed_ids array<string>")
    got = study.analyse(made, q.select("qid", "question_type", "seed_node_ids", "relevant_node_ids"), matched, samples=20)
    assert rows(got["mapping"]) == [("empty", 1), ("exact", 1)] and rows(got["selections"]) == [("C7", "C3", 2)]
    assert {r["condition"] for r in got["intervals"].collect()} == {"C1", "C7"}
    given = spark.createDataFrame([(k, c, "Beta") for k in ("q0", "q1") for c in ("C0", "C1")], "qid string, condition string, answer string")
    asked_ = q.select("qid", "question", "question_type").withColumns({"dataset": F.lit("d"), "gold": F.lit("Beta")})

    class Judge:
        def __init__(self, value):
            self.value = value

        def complete(self, *_, **__):
            return json.dumps({"correctness": self.value, "completeness": 2, "reason": "because"})

    pilot = study.pilot(asked_, given, Judge(4), ("C0", "C1"))
    assert pilot["cases"].count() == 2 and {r["correctness"] for r in pilot["means"].collect()} == {4.0}
    with pytest.raises(Exception, match="invalid rating"):
        study.pilot(asked_, given, Judge(True), ("C0", "C1"))["ratings"].collect()

    class Echo:
        def complete(self, system, user, **_):
            return "Beta" if "context" in user else "nothing"

    two = study.answer_quality(graph, q, made.where("condition = 'C1'").select("qid", "context"), Echo())
    assert {r["condition"]: r["entity_recall"] for r in two["means"].collect()} == {"C0": 0.0, "C1": 0.25} and two["blind"].count() == 2


def test_pairs_for_comparison_meet_once(spark):
    """Two edges meet in their middle once; a pair's middles are its labels, and adjacent pairs are left out."""
    import random

    rng = random.Random(3)
    ids = [f"n{i}" for i in range(30)]
    graph = graph_of(spark, ids, [(rng.choice(ids), rng.choice(ids), 1) for _ in range(70)])
    found = prepare.candidates(graph, graph.nodes.select("id", F.lit("x").alias("category"))).where("question_type = 'comparison'")
    near: dict = {}
    for a, b in (tuple(r) for r in graph.adjacency.collect()):
        near.setdefault(a, set()).add(b)
    both = {(a, b): sorted(near[a] & near[b]) for a in near for b in near if a < b and b not in near[a] and 2 <= len(near[a]) <= 30 and 2 <= len(near[b]) <= 30}
    want = {k: v for k, v in both.items() if 2 <= len(v) <= 10}
    assert want and {tuple(r["seeds"]): r["relevant"] for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
