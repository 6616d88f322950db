import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm import embedding_dedup, shared, warc
from wayfare.llm.token_files import open_uri


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"http://h/{i}", h, "k") for i, h in enumerate(htmls)], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    big, other = "é<p>" * 60, "x" * 100
    htmls = [big, None, "", other, big, "y" * 99, "y" * 99, other, "a\r\n\r\nb" * 40, big]
    plain = warc.write(pages(spark, htmls).repartition(2))
    index = warc.normalise(plain)
    got = {int(r["page_id"]): r for r in warc.read(index).collect()}
    first = {}
    for i, h in enumerate(htmls):
        raw = (h or "").encode()
        want = first.setdefault(raw, i) if len(raw) >= 100 else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == i else ("revisit", str(want)))
    for r in index.collect():  # each record is a member that can be read by itself
        with open_uri(r["path"]) as f:
            f.seek(r["offset"])
            raw = f.read(r["length"])
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(raw)
        assert inflate.eof and not inflate.unused_data and text.startswith(b"WARC/1.1\r\n") and len(text) == r["head"]
    sides = {r["path"].replace(".warc.gz", ".index.jsonl") for r in index.collect()}
    assert sum(open_uri(s).readall().count(b"\n") for s in sides) == len(htmls)
    with open_uri(plain.first()["path"]) as f:  # and the archives before were one stream
        whole = f.readall()
    inflate = zlib.decompressobj(31)
    inflate.decompress(whole)
    assert inflate.eof and not inflate.unused_data


def test_warc_edges(spark):
    df = pages(spark, ["z" * 200])
    twice = df.union(df).union(df.withColumn("page_id", F.lit(None).cast("long")))
    got = warc.read(warc.normalise(warc.write(twice))).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in got) == [("0", "response"), ("0", "response"), ("None", "revisit")]
    assert warc.read(warc.normalise(warc.write(df.where("false")))).count() == 0


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_records_of_any_gzip(step):
    own = [warc.record(i, f"http://u/{i}", "response", "d", 3, None, b"\r\n\r\n" * i) for i in range(5)]
    for raw in (gzip.compress(b"".join(own)), b"".join(map(gzip.compress, own))):
        assert list(warc.records_of(pa.BufferReader(raw), step)) == own
    bomb = warc.record(0, "u", "response", "d", 0, None, b"z" * (20 << 20))
    assert list(warc.records_of(pa.BufferReader(gzip.compress(bomb)), 1 << 20)) == [bomb]
    with pytest.raises(ValueError):
        list(warc.records_of(pa.BufferReader(gzip.compress(own[0][:-9])), step))


def brute_links(rows, threshold=0.93):
    def usable(x):
        return x is not None and len(x) and None not in x and np.isfinite(x).all() and np.any(x)

    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            (la, x), (lb, y) = rows[a], rows[b]
            if la is not None and la == lb and usable(x) and usable(y) and len(x) == len(y):
                x, y = (np.array(v, float) for v in (x, y))
                link[a, b] = link[b, a] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    component = np.arange(n)
    for _ in range(n):
        component = np.array([min(component[a], *component[link[a]], n) for a in range(n)])
    return link.sum(axis=1), component


@pytest.mark.parametrize("chunk", [4, 1500])
def test_embeddings(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    rows = []
    for size in (64, 20, 3):
        for _ in range(6):
            base = rng.normal(size=size)
            for noise in (0.0, 0.0, 0.1, 0.3, 0.37, 0.4):
                x = (base + noise * rng.normal(size=size)) * rng.choice([0.1, 1, 10])
                rows.append((int(rng.integers(0, 2)), x.astype(np.float32).tolist()))
    rows += [(0, None), (None, [1.0] * 64), (0, [0.0] * 64), (0, [float("nan")] + [1.0] * 63), (0, [None] + [1.0] * 63), (0, []), (0, [1e30] * 64), (0, [2e30] * 64), (1, [1e-30] * 3), (1, [2e-30] * 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, l, 0) for i, (l, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, cell int").repartition(3)
    got = {r["id"]: r for r in embedding_dedup.similar(df).collect()}
    links, component = brute_links(rows)
    assert [got[i]["n_links"] for i in range(len(rows))] == links.tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == component.tolist()
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.similar(df.where("false")).count() == 0
    # rows that share an id, or have none, are vectors of their own
    odd = df.withColumn("vec_id", F.expr("if(vec_id % 5 = 0, null, vec_id % 50)"))
    again = embedding_dedup.similar(odd).collect()
    assert sorted(r["n_links"] for r in again) == sorted(links.tolist()) and len(again) == len(rows)
    least: dict = {}
    for i, c in enumerate(component.tolist()):
        key = None if i % 5 == 0 else i % 50
        least[c] = min([x for x in (least.get(c), key) if x is not None], default=None)
    want = [(None if i % 5 == 0 else i % 50, least[c]) for i, c in enumerate(component.tolist())]
    assert sorted(((r["id"], r["component_id"]) for r in again), key=str) == sorted(want, key=str)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in again)


@pytest.mark.parametrize("dimensions,size", [(1, 64), (2, 64), (3, 40), (3, 2)])
def test_grid_of_any_depth_meets_every_close_pair_once(dimensions, size):
    rng = np.random.default_rng(dimensions)
    bases = rng.normal(size=(12, size))
    x = np.concatenate([bases + noise * rng.normal(size=bases.shape) for noise in (0, 0.05, 0.2, 0.35, 0.4)]).astype(np.float32).astype(float)
    distance = 2 - 2 * 0.93 + 1e-9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(["l"] * len(x)), pa.array([size] * len(x), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in x])], ["rep", "label", "size", "vector"])
    cells: dict = {}
    for part in embedding_dedup._celled([batch], distance, dimensions):
        for r in part.to_pylist():
            cells.setdefault(r["cell"], []).append((r["rep"], r["home"], r["block"]))
    seen = []
    for own in cells.values():
        reps, home, block = (np.array(c) for c in zip(*own))
        every = np.arange(len(reps))
        a, b = embedding_dedup.links_in_block(x[reps], home, every, every, int(block[0]), distance, 0.93)
        seen += [tuple(sorted(p)) for p in zip(reps[a].tolist(), reps[b].tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.93
    assert sorted(seen) == [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if close[i, j]]


def test_rotation_is_orthogonal():
    for n in (1, 3, 64):
        r = embedding_dedup.rotation(n)
        assert np.allclose(r @ r.T, np.eye(n))
        blocks = embedding_dedup.blocks_of(n)
        assert blocks[0][0] == 0 and blocks[-1][1] == n and all(a[1] == b[0] for a, b in zip(blocks, blocks[1:]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["v"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and 200 not in got
    assert shared.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_components_of_long_paths(spark):
    adverse = [*range(1, 200), 0]
    shuffled = random.Random(2).sample(range(1000, 1700), 700)
    hub = [(5000, i) for i in range(4000, 4100)]
    edges = [*zip(adverse, adverse[1:]), *zip(shuffled, shuffled[1:]), *hub]
    random.Random(3).shuffle(edges)
    got = {r["v"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in adverse}, **{i: 1000 for i in shuffled}, **{i: 4000 for i in [5000, *range(4000, 4100)]}}


def test_pair_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("m"), (F.col("id") < 45).cast("int").alias("k"))
    dealt = shared.pair_blocks(df, ["k"], "m", 10)
    seen = {}
    for r in dealt.collect():
        seen.setdefault((r["k"], r["chunk_i"], r["chunk_j"]), []).append((r["m"], r["chunk"]))
    pairs = {}
    for (k, i, j), members in seen.items():
        for m, c in members:
            for n, d in members:
                if m < n and {c, d} == {i, j}:
                    pairs[m, n] = pairs.get((m, n), 0) + 1
    assert len(pairs) == 45 * 44 // 2 + 10 and set(pairs.values()) == {1}


def test_warc_ids_of_text(spark):
    """Ids are texts as they are, also those that read like none; a row without an id has none."""
    ids = ["None", "null", "", "a b", None]
    pages = spark.createDataFrame([(i, "http://x", f"page {n}" * 30, "odd") for n, i in enumerate(ids)], "page_id string, url string, html string, path string")
    got = warc.read(warc.normalise(warc.write(pages))).collect()
    assert sorted(str(r["page_id"]) + str(r["page_id"] is None) for r in got) == sorted(str(i) + str(i is None) for i in ids)


def test_vectors_are_merged_whatever_their_files_size(spark, monkeypatch):
    """Numbers are small as files, so by these a table of many would be broadcast through the driver."""
    rows = [(i, [1.0, 0.01 * (i % 7), 0.5], 1) for i in range(40)]
    got = embedding_dedup.similar(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and got.where("n_links = 39 and component_id = 0").count() == 40
    monkeypatch.setattr(shared.sided, "__defaults__", (3,))
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {tuple(r) for r in shared.components(edges, "test").collect()} == {(i, 0) for i in range(10)}
    assert "Broadcast" not in shared.sided(shared.materialise(edges, "test")).join(edges, "a")._jdf.queryExecution().executedPlan().toString()
