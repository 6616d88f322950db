import glob
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from wayfare.llm import jaccard, queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n.startswith("op")} == {str(n) for n in range(1, 14)}
    assert "pipeline" in queries.QUERIES and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    key = lambda t: [(x is None, str(x)) for x in t]
    at = [want.columns.index(c) for c in columns]
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=key) == sorted(([r[i] for i in at] for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name,parts,out", [("op1_quality", 5, 0), ("op4_toxicity", 4, 2)])
def test_classifiers(spark, name, parts, out):
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == 200
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_pipeline(spark):
    """Every stage's decisions, from its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == seen[0].columns
        seen.append(docs)
    text = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen]
    assert set(text[1]) <= set(text[0]) and set(text[4]) == set(text[3])
    groups = {r["id"]: r["class_id"] for r in jaccard.similar(seen[1]).collect()}
    assert set(text[2]) == set(groups.values())
    assert all(text[4][k] == text[3][k] or "[SECRET]" in text[4][k] for k in text[4])
    assert any(text[4][k] != text[3][k] for k in text[4])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids: dict = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + r["ids"]
    assert set(ids) == set(text[4]) and all(np.frombuffer(x, "<u4")[-1] == 1 for x in ids.values())
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def odd_documents(spark):
    """Null and repeated ids, null, empty and very long texts, copies, a secret, and columns that clash with names inside the stages."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long = " ".join(f"word{n}" for n in range(30_000))
    own = [(1, "one two three four five six"), (1, "another text altogether, of its own"), (None, None), (None, ""), (2, None), (3, "token = abcdef0123456789abcdef end"), (3, "token = abcdef0123456789abcdef end"), (None, long), (4, long + " tail"), (5, item), (None, "before " + item)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, path string, spans string, blob int, id double, _path int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "p", "s", 1, 0.5, 9) for i, t in own], kind)


def test_stages_of_odd_documents(spark):
    docs, texts = odd_documents(spark), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and {(r["key"], r["path"], r["spans"], r["blob"], r["id"], r["_path"]) for r in docs.collect()} == {("k", "p", "s", 1, 0.5, 9)}
        texts.append({name: sorted(((str(r["doc_id"]), r["text"] and r["text"][:30]) for r in docs.collect()), key=str)})
    assert len(texts[0]["toxicity"]) == 11
    near = texts[1]["near_duplicates"]
    # the long copy with an id stays before the one without; a null text is an empty one, and equal rows are one
    assert [x[0] for x in near if x[1] and x[1].startswith("word0")] == ["4"] and sum(x[1] in (None, "") for x in near) == 1
    assert sum(x[1] is not None and x[1].startswith("token") for x in near) == 1 and ("1", "another text altogether, of it") in near
    clean = texts[2]["decontamination"]
    assert len(clean) == len(near) - sum(x[1] is not None and (x[0] == "5" or x[1].startswith("before")) for x in near)
    assert ("3", "[SECRET] end") in texts[3]["secrets"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len({x[0] for x in clean})


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_toxicity_stage_uses_the_threshold(spark):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.op4_toxicity(spark, SF).collect()}
    assert kept == {k for k, v in scores.items() if v < corpus_pipeline.TOXIC}
    assert toxicity.fold("A") == " a "
