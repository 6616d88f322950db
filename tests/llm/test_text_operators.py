import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfare.llm import decontamination, jaccard, packing, quality, secret_scan, token_files, toxicity
from wayfare.llm import repeats as rp
from wayfare.llm.tokenizing import Encoder

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "é" * 300, "x" * 20_000, "a  b\n c ", "Ω \t\n", "\x00 a", "a <|endoftext|>, <|startoftext|>b"]


def docs(spark, texts, extra=True):
    """Documents with ids from 0 and columns that clash with names inside the operators."""
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, blob string, bucket double")
    return df if extra else df.select("doc_id", "text")


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


# ---- tokenizing, token files, packing ----------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("generation", [5, 400_000])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list(" \n\taAé'sß,.!_²1İΣ<|ﬁ\x1ć\xa0")), max_size=60), max_size=8))
def test_encoder_is_the_library(path, generation, texts):
    own = ENCODERS.setdefault((path, generation), Encoder(path))
    own.LIMIT = generation
    texts = texts + ["<|endoftext|> x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "don't  stop", "a" * 23 + " " + "a" * 24, "é" * 11 + " a" + "é" * 11, "x" * 5000 + " y", "a.\nB\né\n\nx\n y \nz,\n", "\n \na\n"]
    want = [x.ids for x in FRESH[path].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want


ENCODERS: dict = {}
FRESH = {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


def test_added_tokens_are_single_ids():
    assert Encoder(BYTES).encode(["a <|endoftext|> b"])[0].tolist().count(50256) == 1
    assert Encoder(WORDS).encode(["a <|endoftext|> b"])[0].tolist().count(49407) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.data())
def test_token_file_round_trip(ids, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=3))) + [len(ids)]
    raw = b"".join(token_files.encode([None, *range(1, len(cuts))], np.array(cuts), np.array(ids, "<u4")))
    file = token_files.TokenFile(pa.BufferReader(raw))
    assert file.range(0, len(ids)).tolist() == ids
    for i in data.draw(st.lists(st.integers(0, max(0, len(ids) - 1)), max_size=5)) if ids else []:
        assert file.token(i) == ids[i] and file.range(i, len(ids)).tolist() == ids[i:]
    own, null, ends = file.table()
    assert ends.tolist() == cuts and null.tolist() == [True] + [False] * (len(cuts) - 1)
    with pytest.raises(IndexError):
        file.token(len(ids))


def library_ids(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_files_and_runs_of_a_bounded_size(spark, tmp_path):
    """What a task writes and reads in many files and runs is what it does in one."""
    texts = ["word " * n for n in range(40)] + ["", None]
    df = docs(spark, texts).repartition(2)
    want = {r["doc_id"]: tuple(r) for r in token_files.read_documents(token_files.write(df, BYTES, end_id=2)).collect()}
    rows = [(i, t) for i, t in enumerate(texts)]

    class Task:
        partitionId, taskAttemptId = staticmethod(lambda: 0), staticmethod(lambda: 7)

    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.string())], ["id", "text"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files.TaskContext, "get", staticmethod(lambda: Task))
        patch.setattr(token_files, "FILE_IDS", 100)
        patch.setattr(token_files, "RUN_IDS", 64)
        files = [f.to_pylist()[0] for f in token_files._written((batch.slice(i, 5) for i in range(0, len(rows), 5)), f"file://{tmp_path}/t", BYTES, 2)]
        assert len(files) > 4 and [f["serial"] for f in files] == list(range(len(files)))
        bases = np.append(0, np.cumsum([f["n_tokens"] for f in files]))
        manifest = pa.RecordBatch.from_arrays([pa.array([f["path"] for f in files]), pa.array(bases[:-1])], ["path", "base"])
        got = [tuple(r.values()) for b in token_files._read([manifest]) for r in b.to_pylist()]
    assert {r[0]: r for r in got} == want


def test_token_files(spark):
    df = docs(spark, ODD)
    got = by_id(token_files.read_documents(token_files.write(df.repartition(3), BYTES, end_id=2)), "doc_id")
    at = 0
    for i, text in enumerate(ODD):
        ids = library_ids(BYTES, text, 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    twice = token_files.read_documents(token_files.write(df.union(df).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), BYTES, end_id=2))
    assert twice.count() == 2 * len(ODD) + 1
    assert token_files.read_documents(token_files.write(df.where("false"), BYTES, end_id=2)).count() == 0


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append(r)
    return out


def check_pieces(rows, limits):
    for own in sequences(rows).values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == limits.tokens or at & (at - 1) == 0
        assert len(own) <= limits.segments and sum(r["loss_tokens"] for r in own) <= limits.loss


def test_packing_texts(spark):
    texts = ODD + ["word " * n for n in (1, 5, 700, 3000)] * 3
    limits = packing.Limits(256, 4, 200)
    rows = packing.pack_texts(docs(spark, texts), WORDS, end_id=1, limits=limits).collect()
    check_pieces(rows, limits)
    for i, text in enumerate(texts):
        ids = library_ids(WORDS, text, 1)
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == ids.tobytes()
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
    assert packing.pack_texts(docs(spark, texts).where("false"), WORDS, end_id=1).count() == 0


def test_packing_with_loss(spark):
    rng = random.Random(2)
    own = [(i, [rng.randrange(9) for _ in range(n)], [rng.random() < 0.6 for _ in range(n)]) for i, n in enumerate([0, 1, 3, 40, 100, 33] * 9)]
    df = spark.createDataFrame(own, "k long, ids array<int>, loss array<boolean>")
    limits = packing.Limits(64, 3, 20)
    rows = packing.pack_ids(df, id_col="k", ids_col="ids", loss_col="loss", limits=limits).collect()
    check_pieces(rows, limits)
    for i, ids, loss in own:
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) and sum(r["loss_tokens"] for r in mine) == sum(loss)
    with pytest.raises(ValueError):
        packing.Limits(0)


# ---- secrets -----------------------------------------------------------------------------------------------------


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "Api_Key", "ſecret", "=", ":", " ", '"', "abcdef0123456789", "0123456789abcde", "AKIA", "ABCDEFGH1234567", "é", "-", "x", "z" * 12, "\n"]), max_size=14))
def test_scan_finds_the_base_spans(parts):
    text = "".join(parts)
    got = [s for s in secret_scan.scan(text) if s[0] in ("assign", "access", "hex")]
    assert sorted(got) == sorted(base_spans(text))


def test_more_kinds():
    text = "k -----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY----- ghp_" + "k" * 36 + " postgres://u:pass@h"
    assert [s[0] for s in secret_scan.scan(text)] == ["pem", "git", "url"]
    cut = "-----BEGIN PRIVATE KEY-----\n" + "A" * 64 + "\nand prose that goes on"
    assert secret_scan.scan(cut) == [("pem", 0, 28 + 64)]


def test_ledger(spark, tmp_path):
    secret = "token = abcdef0123456789abcdef"
    df = docs(spark, [secret, secret, "clean", None, ""])
    folder = str(tmp_path / "ledger")
    for _ in range(2):
        got = by_id(secret_scan.scan_versions(df, path_col="doc_id", text_col="text", ledger=folder), "path")
        assert [len(got[i]["spans"]) for i in range(5)] == [2, 2, 0, 0, 0]
        assert spark.read.parquet(folder).count() == 3  # each blob once
    more = df.union(df.limit(1).withColumn("text", F.lit("new AKIA" + "B" * 16)))
    secret_scan.scan_versions(more, path_col="doc_id", text_col="text", ledger=folder).count()
    assert spark.read.parquet(folder).count() == 4
    secret_scan.scan_versions(df, path_col="doc_id", text_col="text", ledger=folder, rules="other").count()
    assert spark.read.parquet(folder).count() == 7
    assert secret_scan.scan_versions(df.where("false"), path_col="doc_id", text_col="text").count() == 0
    same = secret_scan.scan_versions(df.union(df), path_col="doc_id", text_col="text")
    assert same.count() == 10
    # an append that was retried: every row twice
    spark.read.parquet(folder).cache().write.mode("append").parquet(folder)
    again = secret_scan.scan_versions(df, path_col="doc_id", text_col="text", ledger=folder).collect()
    assert sorted((r["path"], len(r["spans"])) for r in again) == [(0, 2), (1, 2), (2, 0), (3, 0), (4, 0)]
    assert spark.read.parquet(folder).count() == 14


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    """Two versions of two paths under two rule versions: what the ledger holds is believed, not scanned again."""
    folder = str(tmp_path / "ledger")
    first = docs(spark, ["password = abcdefghijkl", "token: mnopqrstuvwx"])
    secret_scan.scan_versions(first, path_col="doc_id", text_col="text", ledger=folder).count()
    marked = [(secret_scan.hashlib.sha256(b"password = abcdefghijkl").hexdigest(), "later", [("pem", 1, 2)])]
    spark.createDataFrame(marked, secret_scan.LEDGER).write.mode("append").parquet(folder)
    versions = first.union(first.withColumn("text", F.concat("text", F.lit("!"))))
    got = secret_scan.scan_versions(versions, path_col="doc_id", text_col="text", ledger=folder, rules="later").collect()
    kinds = sorted((r["path"], [s["kind"] for s in r["spans"]]) for r in got)
    assert kinds == [(0, ["assign"]), (0, ["pem"]), (1, ["assign"]), (1, ["assign"])]
    assert spark.read.parquet(folder).where("rules = 'later'").count() == 4 and spark.read.parquet(folder).count() == 6


def test_redact(spark):
    df = docs(spark, ["é token = abcdef0123456789abcdef!"])
    found = secret_scan.scan_versions(df, path_col="doc_id", text_col="text")
    got = df.join(found, F.col("doc_id") == F.col("path")).select(secret_scan.redact(F.col("text"), F.col("spans"))).first()[0]
    assert got == "é [SECRET]!"


# ---- near duplicates ---------------------------------------------------------------------------------------------


def brute_jaccard(texts, threshold=0.8):
    sets = [set(jaccard.shingles(t, 5).tolist()) for t in texts]
    n = len(texts)

    def same(a, b):
        if not sets[a] or not sets[b]:
            return not sets[a] and not sets[b] and (texts[a] or "") == (texts[b] or "")
        return len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12

    link = [[a != b and same(a, b) for b in range(n)] for a in range(n)]
    component = list(range(n))
    for _ in range(n):
        component = [min([component[a]] + [component[b] for b in range(n) if link[a][b]]) for a in range(n)]
    return [sum(x) for x in link], component


def edited(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [3, 256])
def test_jaccard(spark, monkeypatch, chunk):
    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    bases = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(120)) for _ in range(4)]
    texts = [edited(rng, b, k) for b in bases for k in (0, 0, 1, 1, 2, 2, 3, 9)] + [edited(rng, bases[0], 1) for _ in range(12)]
    texts += [None, "", "", "...", "one two", "One, two", "one two three", "y " * 5000]
    want = brute_jaccard(texts)
    got = by_id(jaccard.similar(docs(spark, texts).repartition(3)))
    assert [got[i]["n_links"] for i in range(len(texts))] == want[0]
    assert [got[i]["class_id"] for i in range(len(texts))] == want[1]
    assert jaccard.similar(docs(spark, texts).where("false")).count() == 0


def test_jaccard_repeated_and_missing_ids(spark):
    rng = random.Random(4)
    base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))
    own = [(1, "a b c d e f"), (1, base), (2, "a b c d e f"), (3, edited(rng, base, 1)), (None, edited(rng, base, 2)), (None, "alone"), (None, "alone"), (3, "z")]
    df = spark.createDataFrame([(i, t, 0) for i, t in own], "doc_id long, text string, key int")
    got = sorted(((r["id"], r["class_id"], r["n_links"]) for r in jaccard.similar(df.repartition(3)).collect()), key=str)
    order = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0))
    links, component = brute_jaccard([own[k][1] for k in order])
    want = sorted(((own[k][0], own[order[component[n]]][0], links[n]) for n, k in enumerate(order)), key=str)
    assert got == want and len(got) == len(own)


# ---- decontamination ---------------------------------------------------------------------------------------------


def brute_overlap(text, item, window=15, substitutions=3):
    t, i = (re.findall(r"\w+", x.lower()) for x in (text or "", item or ""))
    if not i:
        return None
    width = min(window, len(i))
    needed = window - substitutions if width == window else width - width * substitutions // window
    best = 0
    for d in range(-len(i), len(t)):
        same = [0 <= p + d < len(t) and t[p + d] == i[p] for p in range(len(i))]
        best = max(best, max(sum(same[s : s + width]) for s in range(len(i) - width + 1)))
    return best if best >= needed else None


def test_decontamination(spark):
    rng = random.Random(8)
    items = [" ".join(f"b{rng.randrange(400)}" for _ in range(n)) for n in (15, 20, 40, 16)] + [None, "", "too short"]
    texts = []
    for item in items[:4]:
        for changes in (0, 1, 2, 3, 4, 8):
            words = item.split()
            for p in rng.sample(range(len(words)), changes):
                words[p] = "other"
            texts.append("intro " * rng.randrange(5) + " ".join(words).upper() + ", end")
    texts += [items[2][: len(items[2]) // 2], None, "", "w " * 3000, items[0] + " " + items[1]]
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)], "item_id long, text string, seed int")
    want = {(d, i): brute_overlap(t, x) for d, t in enumerate(texts) for i, x in enumerate(items)}
    got = {(r["id"], r["item"]): r["best"] for r in decontamination.overlaps(docs(spark, texts), bench).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert decontamination.overlaps(docs(spark, texts).where("false"), bench).count() == 0
    # rows that share an id keep their own texts, and so do rows without one
    shared = docs(spark, texts).withColumn("doc_id", F.expr("if(doc_id % 3 = 0, null, doc_id % 2)"))
    merged: dict = {}
    for (d, i), v in want.items():
        if v is not None:
            key = (None if d % 3 == 0 else d % 2, i)
            merged[key] = max(v, merged.get(key, 0))
    assert {(r["id"], r["item"]): r["best"] for r in decontamination.overlaps(shared.union(shared), bench).collect()} == merged
    assert decontamination.overlaps(docs(spark, texts), bench.where("false")).count() == 0


def test_masks_meet_every_three_substitutions():
    from itertools import combinations

    for gone in combinations(range(15), 3):
        assert any(not set(gone) & {s + m for m in mask} for mask in decontamination.MASKS for s in range(15 - mask[-1]))


def test_decontamination_of_repetitive_texts(spark):
    """100,000 repeated words against an item of them: hits are many, places unlike each other few."""
    words = "buy now " * 50_000
    shifted = "one " + "buy now cheap " * 3000 + "end of it all"
    texts = [words, words + "but this ends otherwise", shifted, "buy now", "buy now " * 5, "buy it " * 20, "sold " * 100_000]
    bench = spark.createDataFrame([(1, "buy now " * 20), (2, "cheap buy now " * 9), (3, "sold " * 40 + "out"), (4, "sold sold sold"), (5, "now buy " * 3000)], "item_id long, text string")
    began = time.perf_counter()
    got = {(r["id"], r["item"]): (r["best"], r["needed"]) for r in decontamination.overlaps(docs(spark, texts), bench).collect()}
    assert time.perf_counter() - began < 60
    assert got == {(0, 1): (15, 12), (1, 1): (15, 12), (0, 5): (15, 12), (1, 5): (15, 12), (2, 2): (15, 12), (6, 3): (15, 12), (6, 4): (3, 3)}


@pytest.mark.parametrize("places", [[4090, 4095, 4096, 4100, 8191]])
def test_decontamination_across_chunks(spark, places):
    """Overlaps where chunks of tokens meet, at a text's ends, and with items of more than a chunk."""
    rng = random.Random(4)
    item = [f"i{n}" for n in range(30)]
    long = [f"l{n}" for n in range(9000)]
    texts = []
    for n, at in enumerate(places):
        own = [f"d{n}x{rng.randrange(10**6)}" for _ in range(9000)]
        own[at : at + 15] = item[10:25]
        own[at + 3] = own[at + 7] = own[at + 11] = "changed"
        texts.append(" ".join(own))
    texts += [" ".join(["a"] * 3 + long[4085:4100]), " ".join(long[8990:] + ["z"] * 5000 + item[:12])]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, text string")
    got = {(r["id"], r["item"]): r["best"] for r in decontamination.overlaps(docs(spark, texts), bench).collect()}
    assert got == {**{(n, 1): 12 for n in range(len(places))}, (len(places), 2): 15, (len(places) + 1, 1): 12}


def test_decontamination_by_items_shorter_than_the_window(spark):
    from itertools import combinations

    items = [[f"s{n}x{p}" for p in range(n)] for n in range(1, 15)] + [["a", "b", "a", "b"], ["a", "b"]]
    texts, want = ["", "a b", "b a b a b"], {(1, 15): 2, (2, 14): 4, (2, 15): 2}
    for i, item in enumerate(items[:14]):
        n = len(item)
        for changes in range(min(n, n // 5 + 2)):
            for gone in combinations(range(n), changes):
                words = ["other" if p in gone else w for p, w in enumerate(item)]
                if changes <= n // 5:
                    want[len(texts), i] = n - changes
                texts.append(" ".join(["intro"] * (len(texts) % 3) + words + ["end"] * (len(texts) % 2)).upper())
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontamination.overlaps(docs(spark, texts), bench).collect()
    assert {(r["id"], r["item"]): r["best"] for r in got} == want
    assert all(r["needed"] == (n := len(items[r["item"]])) - n // 5 for r in got)


# ---- repeated bytes ----------------------------------------------------------------------------------------------


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("segment,seed,length", [(1 << 20, 1, 100), (150, 2, 100), (400, 3, 100), (1 << 20, 4, 1), (90, 5, 2), (64, 6, 11), (700, 7, 257)])
def test_repeats(spark, monkeypatch, segment, seed, length):
    rng = random.Random(seed)
    monkeypatch.setattr(rp, "SEGMENT", segment)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (90, 95, 99, 100, 130, 260, 700)]
    texts = [None, "", "short", "ab" * 300, "z" * 500, "z" * 99]
    for _ in range(25):
        parts = [noise(rng.randrange(0, 120))]
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40)
            parts += [s[a:], noise(rng.randrange(0, 60))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2] + "x", shared[5] * 3]
    got = by_id(rp.repeated(docs(spark, texts).repartition(4), length=length))
    want = brute_repeats(texts, length)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in (got[i] for i in range(len(texts)))] == want


def test_repeats_of_nothing(spark):
    assert rp.repeated(docs(spark, ["q" * 120]).where("false")).count() == 0
    with pytest.raises(ValueError):
        rp.Shape(0)
    assert rp.Shape(100).widths == [64, 100] and rp.Shape(257).widths == [128, 256, 257] and rp.Shape(1).widths == [1]


def test_repeats_with_repeated_and_missing_ids(spark):
    own = [(1, "q" * 10), (1, "q" * 300), (0, "w" * 50), (None, "q" * 120 + "end"), (2, "q" * 120 + "end"), (2, "q" * 120 + "end"), (None, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in own], "doc_id long, text string, key int")
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}
    order = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, hashed[own[k][1]]))
    want = brute_repeats([own[k][1] for k in order])
    got = rp.repeated(df.repartition(3)).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((str(own[k][0]), *w) for k, w in zip(order, want))


# ---- classifiers -------------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("Ѕtupid, 1d10t! ｆｏｏｌ 404 $$$") == " stupid idiot fool 404 "
    assert toxicity.fold(None) == "  "


def test_lexicon():
    own = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0}, (" trash can ",), (-1.0, 1.0, 1.0, 0.0))
    a = own.automaton()
    assert toxicity.measures(toxicity.fold("a trash trash"), a)[1] == 2.0
    assert toxicity.measures(toxicity.fold("the trash can"), a) == (0.0, 0.0, 0.0)
    low, high, empty = toxicity._scores(["fine words", "tr4sh", None], own, a)
    assert low == empty < high


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["trash", "trashy", "can", "scum", "the", "tr4sh", "scums", "x", "Ѕcum", "!"]), max_size=9))
def test_lexicon_agrees_with_brute_force(words):
    """Every pattern looked for at every word, one by one."""
    own = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0, " scum ": 1.5, " scu": 1.75, " the ": 0.5}, (" trash can ", " the scum "), (0.0, 1.0, 1.0, 1.0))
    folded = toxicity.fold(" ".join(words))
    begins = [i for i, c in enumerate(folded) if c == " "]
    best = {i: max((w for p, w in own.weights.items() if folded.startswith(p, i)), default=0.0) for i in begins}
    for phrase in own.exceptions:
        for i in begins:
            if folded.startswith(phrase, i):
                for at in range(i, i + len(phrase) - 2):
                    best.pop(at, None)
    hits = sorted(w for w in best.values() if w)
    n = max(1, len(folded.split()))
    want = (sum(hits) / n**0.5, max(hits, default=0.0), np.log1p(100 * len(hits) / n))
    assert toxicity.measures(folded, own.automaton()) == pytest.approx(want)


def test_repeated_labelled_ids_keep_the_sample_bounded(spark):
    df, labels = unequal(spark, 80)
    many = df.union(df).union(df.withColumn("text", F.concat("text", F.lit(" again")))).union(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert toxicity.training_rows(many, labels.union(labels), "toxic", F.lit(True), 4096).count() == 80
    assert quality.score(many, quality.fit(many, labels, F.lit(True))).count() == 320


def labelled(spark, bad, good, n=160):
    rng = random.Random(3)
    own = []
    for i in range(n):
        words = [f"w{rng.randrange(60)}" for _ in range(40)]
        own.append((i, bad(words, rng) if i % 3 == 0 else good(words)))
    own += [(n, None), (n + 1, ""), (n + 2, "w1 " * 30_000)]
    df = spark.createDataFrame([(i, t, "t") for i, t in own], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return df, labels, n


def test_toxicity_learns(spark):
    def bad(words, rng):
        words[rng.randrange(40)] = rng.choice(["m0ron", "scum!!", "MORON"])
        return " ".join(words)

    df, labels, n = labelled(spark, bad, " ".join)
    own = toxicity.fit(df, labels, F.col("doc_id") % 4 != 2, support=2)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score(F.col("text"), own).alias("s")).collect()}
    held = [i for i in range(n) if i % 4 == 2]
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in held) and all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(df, labels.where("false"), F.lit(True))
    assert df.select(toxicity.score(F.col("text"), none).alias("s")).where("s > 0.01").count() == 0


def test_quality_learns(spark):
    df, labels, n = labelled(spark, lambda w, rng: " ".join(f"{x}###" for x in w), " ".join)
    own = quality.fit(df, labels, F.col("doc_id") % 5 != 0, bound=200)
    got = {r["id"]: r["score"] for r in quality.score(df, own).collect()}
    assert len(got) == n + 3 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 3 != 0) for i in range(0, n, 5))
    assert got[n] == got[n + 1] == pytest.approx(own.prior)
    empty = quality.fit(df, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality.score(df, empty).collect()} == {0.5}


def test_votes_agree_with_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    voters, asked = unit(rng.normal(size=(60, 8))), unit(rng.normal(size=(9, 8)))
    labels = rng.integers(0, 2, 60).astype(float)
    own = quality.Neighbours(np.zeros((1, 8)), voters, labels, 0.5, 7, 2.0)
    for x, got in zip(asked, own.vote(asked)):
        cosine = voters @ x
        near = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[near], 0) ** 2
        assert got == pytest.approx((weight * labels[near]).sum() / weight.sum())


def unequal(spark, n=600):
    """One row of eight has label 1, and words say nothing about it."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(n)], "doc_id long, text string")
    return df, spark.createDataFrame([(i, int(i % 8 == 0), int(i % 8 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bound", [50, 200, 4096])
def test_class_shares_outlast_the_bound(spark, bound):
    df, labels = unequal(spark)
    rows = toxicity.training_rows(df, labels, "toxic", F.lit(True), bound).collect()
    assert sum(r["weight"] for r in rows if r["label"] == 1) == pytest.approx(75) and sum(r["weight"] for r in rows) == pytest.approx(600)
    own = quality.fit(df, labels, F.lit(True), bound=bound)
    assert own.prior == pytest.approx(1 / 8)
    assert np.mean([r["score"] for r in quality.score(df, own).collect()]) == pytest.approx(1 / 8, abs=0.06)
    lexicon = toxicity.fit(df, labels, F.lit(True), bound=bound, support=10**6)
    assert toxicity._scores(["w1 w2"], lexicon, lexicon.automaton()) == pytest.approx([1 / 8], abs=0.06)


def test_logistic_with_weights_is_the_one_of_repeated_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0.8).astype(float)
    times = np.where(y == 0, 7, 1)
    want = toxicity._logistic(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert toxicity._logistic(x, y, times.astype(float)) == pytest.approx(want, rel=0.02, abs=0.02)


def test_packing_of_conversations_under_three_limits(spark):
    """Answers of the given conversations bear loss; tokens, segments and loss end some sequences each, and none is exceeded."""
    path = "/root/testdata/sf0.01/conversations.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    turns: dict = {}
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        ids = FRESH[WORDS].encode(r["text"] or "", add_special_tokens=False).ids
        own = turns.setdefault(r["conv_id"], ([], []))
        own[0].extend(ids), own[1].extend([r["role"] == "assistant"] * len(ids))
    limits = packing.Limits(tokens=512, segments=2, loss=400)
    df = spark.createDataFrame([(k, i, x) for k, (i, x) in turns.items()], "conv_id long, ids array<long>, loss array<boolean>").coalesce(1)
    packed = lambda own: packing.pack_ids(df, id_col="conv_id", ids_col="ids", loss_col="loss", limits=own).collect()

    def totals(rows):
        bins: dict = {}
        for r in rows:
            a, b, c = bins.get(r["sequence_id"], (0, 0, 0))
            bins[r["sequence_id"]] = a + r["length"], b + 1, c + r["loss_tokens"]
        return list(bins.values())

    got = packed(limits)
    for r in got:
        ids, flags = turns[r["doc_id"]]
        end = r["start"] + r["length"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : end] and r["loss_tokens"] == sum(flags[r["start"] : end])
    assert sorted((r["doc_id"], p) for r in got for p in range(r["start"], r["start"] + r["length"])) == sorted((k, p) for k, (ids, _) in turns.items() for p in range(len(ids)))
    assert all(a <= 512 and b <= 2 and c <= 400 for a, b, c in totals(got))
    # without any one of them that one is exceeded, so each ends sequences
    assert any(a > 512 for a, _, _ in totals(packed(packing.Limits(544, 2, 400))))
    assert any(b > 2 for _, b, _ in totals(packed(packing.Limits(512, 600, 400))))
    assert any(c > 400 for _, _, c in totals(packed(packing.Limits(512, 2, 512))))
