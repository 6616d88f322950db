import hashlib
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wayfare.functions import text as tx


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column).first()[0]


@pytest.mark.parametrize("raw", ["Straße", "ΟΔΟΣ  ", "ﬁne", "a b", "a\x1cb", "  Mixed \t Case\n", "", "İx"])
def test_folding_agrees_with_the_standard_library(spark, raw):
    df = tx.with_folded(spark.createDataFrame([(raw,)], ["t"]), "t", "n")
    assert df.first()["n"] == " ".join(raw.casefold().split())


def test_null_stays_null(spark):
    assert tx.with_folded(spark.createDataFrame([(None,)], "t string"), "t", "n").first()["n"] is None


def test_trigrams(spark):
    assert value(spark, tx.trigrams(F.col("t")), t="ab") == ["  a", " ab", "ab ", "b  "]


@pytest.mark.parametrize("a,b,want", [("x", "x", 1.0), ("", "x", 0.0), ("", "", 1.0), ("kitten", "sitting", 1 - 3 / 7), ("ab", "a😀", 0.5)])
def test_edit_similarity(spark, a, b, want):
    assert value(spark, tx.edit_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(
    "question,kind,depth",
    [
        ("which pages directly neighbor x", "direct", 1), ("which are liked by both x and y", "comparison", 2), ("the shortest path between x and y", "path", 3),
        ("pages similar to x two hops away", "similarity", 2), ("why is x", None, 2), ("empathy of x", None, 3), ("x vs y", None, 2), ("x", None, 1),
    ],
)
def test_wording(spark, question, kind, depth):
    r = spark.createDataFrame([(question,)], ["q"]).select(tx.question_type(F.col("q")).alias("k"), tx.rule_parameters(F.col("q")).alias("p")).first()
    assert (r["k"], r["p"]["depth"]) == (kind, depth)


def test_heuristic_keywords(spark):
    assert value(spark, tx.heuristic_keywords(F.col("q")), q="Who is Donald Trump?") == ["Donald", "Trump"]


def test_explicit_ids(spark):
    assert value(spark, tx.explicit_user_ids(F.col("q")), q="is deezer  User 32 near Deezer user 7x or Deezer user 8?") == ["deezer  User 32", "Deezer user 8"]


def test_seeded_order_is_the_standard_shuffle(spark):
    want = list("ABCDE")
    random.Random(int.from_bytes(hashlib.sha256(b"5:q1").digest(), "big")).shuffle(want)
    assert value(spark, tx.seeded_order(5, F.col("k"), tuple("ABCDE")), k="q1") == want


def test_digests(spark):
    assert value(spark, tx.blind_first(9, F.col("k")), k="é") == hashlib.sha256("9:é".encode()).digest()[0] % 2
    assert value(spark, tx.pair_id(9, F.col("k")), k="q") == hashlib.sha256(b"pair:9:q").hexdigest()[:12]
    assert value(spark, tx.numeric_id(F.col("k")), k="fb_012") == 12


def test_templates(spark):
    assert value(spark, tx.templated("To {b} from {a}.", F.col("x"), F.col("y")), x="A%", y="B") == "To B from A%."
    assert tx.social_templates("users", "friendships")["direct"] == "Which users have a direct friendship with {a}"
    assert rows(spark.range(1).select(tx.prefixed("gh", F.lit(7)).alias("x"))) == [("gh_7",)]
