"""BM25 with its skip, against the whole computation."""

import math
import random
import re
from collections import Counter

import pytest
from wayfare.operators import ranking


def plain(queries, texts, k, k1, b):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts}
    mean, n = sum(map(len, words.values())) / len(words), len(words)
    df = Counter(w for own in words.values() for w in set(own))
    out = []
    for q, text in queries:
        scores = {}
        for i, own in words.items():
            tf = Counter(own)
            shared = set(re.findall(r"\w+", (text or "").lower())) & set(own)
            if shared:
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(own) / mean)) for w in shared), 9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return out


@pytest.mark.parametrize("k,k1,b", [(1, 1.2, 0.75), (5, 1.2, 0.75), (200, 2.0, 0.0), (3, 0.5, 1.0)])
def test_bm25(spark, k, k1, b):
    rng = random.Random(8)
    # common words in nearly all texts, rare ones in few, and texts that repeat each other
    words = ["the", "of", "a"] * 12 + ["Red", "blue", "é", "x_1"] * 3 + [f"rare{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    texts += [(150 + i, texts[i][1]) for i in range(20)] + [(200, None), (201, ""), (202, "the " * 500)]
    queries = [("common", "the of a the"), ("mixed", "The rare1, rare2 of blue."), ("one", "rare7"), ("none", "zebra"), ("empty", ""), ("null", None), ("all", " ".join(words))]
    got = ranking.bm25(spark.createDataFrame(queries, "qid string, text string"), spark.createDataFrame(texts, "id int, text string"), k, k1=k1, b=b).collect()
    assert sorted((r["qid"], r["rank"], r["id"], round(r["score"], 8)) for r in got) == sorted((*x[:3], round(x[3], 8)) for x in plain(queries, texts, k, k1, b))


def test_bm25_of_nothing(spark):
    queries, none = spark.createDataFrame([("q", "a")], "qid string, text string"), spark.createDataFrame([], "id int, text string")
    assert ranking.bm25(queries, none).collect() == [] and ranking.bm25(queries.where("false"), none).collect() == []
    with pytest.raises(ValueError):
        ranking.bm25(queries, none, 0)
