"""One quoted CSV read by many tasks, against Python's csv."""

import csv
import io
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wayfare.sources.files import write_csv
from wayfare.sources.graph import ranked_by
from wayfare.sources.quoted_csv import read_quoted_csv


def body(rng, n):
    """Rows of fields with line ends, quotes and commas, some of many lines; and a text of them, with both line ends and blank lines."""
    words = ["a", 'say ""no""'.replace('""', '"'), "one\ntwo", "\n\n", "x,y", "é", " spaced ", '"', "\n" * 40 + "long", "line\n" * 30]
    own = [[str(i), rng.choice(words), rng.choice([*words, None])] for i in range(n)]
    quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if set(v) & set('",\n ') or rng.random() < 0.3 else v
    return own, "".join(",".join(map(quoted, r)) + rng.choice(["\n", "\n", "\r\n", "\n\n"]) for r in own)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_file_by_many_tasks(spark, tmp_path, small_splits, seed):
    own, text = body(random.Random(seed), 120)
    path = tmp_path / "one.csv"
    path.write_text("﻿id,first,second\n" + text, encoding="utf-8", newline="")
    assert [r[1] for r in csv.reader(io.StringIO(text, newline="")) if r] == [r[1] for r in own]
    df = read_quoted_csv(spark, str(path))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20 and df.columns == ["id", "first", "second", "_pos"]
    found = df.orderBy("_pos").collect()
    assert [[r["id"], r["first"], r["second"]] for r in found] == own


def test_many_files(spark, tmp_path, small_splits):
    rng, want = random.Random(9), []
    for name in ("b", "a", "c"):
        own, text = body(rng, 40)
        (tmp_path / f"{name}.csv").write_text("id,first,second\n" + text, encoding="utf-8", newline="")
        want.append((name, own))
    found = read_quoted_csv(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [[r["id"], r["first"], r["second"]] for r in found] == [r for _, own in sorted(want) for r in own]


def test_faults(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(Exception, match="does not end"):
        read_quoted_csv(spark, write("open.csv", 'a,b\n1,"x\n2,y\n')).collect()
    with pytest.raises(ValueError, match="no header"):
        read_quoted_csv(spark, write("empty.csv", ""))
    with pytest.raises(ValueError, match="repeats"):
        read_quoted_csv(spark, write("twice.csv", "a,A\n1,2\n"))
    with pytest.raises(ValueError, match="different headers"):
        read_quoted_csv(spark, [write("p.csv", "a,b\n1,2\n"), write("q.csv", "b,a\n1,2\n")])
    with pytest.raises(Exception, match="MALFORMED"):
        read_quoted_csv(spark, write("short.csv", "a,b\n1\n")).collect()
    assert rows(read_quoted_csv(spark, write("none.csv", "a,b\n")), "a", "b") == []
    assert rows(read_quoted_csv(spark, write("nulls.csv", 'a,b\n,""\nx,\n')), "a", "b", "_pos") == [("x", None, 1), (None, None, 0)]


def test_ordered_csv_is_written_by_several_tasks(spark, tmp_path):
    """One task sorted and held all rows before; ranks come without one too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        own = spark.range(400).select((F.col("id") * 7 % 400).alias("k"), F.lit('a\n"b"').alias("v"))
        write_csv(own, str(tmp_path / "c"), ["k"])
        ranked = ranked_by(own.withColumn("k", F.col("k") * 3), "k", "nth")
        assert rows(ranked.where("nth <> k / 3 + 1")) == [] and ranked.count() == 400 and ranked.columns == ["k", "v", "nth"]
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "c").glob("part-*"))) > 1
    found = read_quoted_csv(spark, str(tmp_path / "c")).orderBy("_pos").collect()
    assert [(int(r["k"]), r["v"]) for r in found] == [(k, 'a\n"b"') for k in range(400)]
    assert rows(ranked_by(own.limit(0), "k", "nth")) == []
