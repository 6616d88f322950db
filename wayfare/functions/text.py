"""Text functions: normalisation, shingles, similarity, question wording, seeded order."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wording that sets a question's parameters, in order of precedence; all are substrings.
MULTI_HOP = ("connection", "connect", "through", "chain", "indirect", "path")
EXPLANATORY = ("why", "how did", "explain", "effect", "impact", "influence")
COMPARISON = ("compare", "difference", "similar", "both", "versus", " vs ")
#: Words that are never keywords.
STOP = ("what", "when", "where", "which", "who", "why", "how", "is", "did", "does", "the", "and", "are", "was", "were", "with", "from", "into")
#: Text for which lower case and blanks mean the same in every engine.
PLAIN = r"^[\x20-\x7e\t\n\r]*$"


def fold(text: str) -> str:
    """Case folded, with single spaces for white space."""
    return " ".join(text.casefold().split())


def plain_fold(text: Column) -> Column:
    """fold() for PLAIN text, inside the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


@F.arrow_udf(T.StringType())
def any_fold(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else fold(x) for x in text.to_pylist()], pa.string())


def with_folded(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds fold(column): PLAIN text is folded in the JVM, and Python sees a null in its place."""
    plain = F.coalesce(F.col(column).rlike(PLAIN), F.lit(True))
    other = any_fold(F.when(~plain, F.col(column)))
    return df.withColumn(out, F.when(plain, plain_fold(F.col(column))).otherwise(other))


def trigrams(folded: Column) -> Column:
    """The distinct three-character pieces of the text between two spaces on either side."""
    padded = F.concat(F.lit("  "), folded, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def edit_similarity(left: Column, right: Column) -> Column:
    """One less the edit distance by the longer length, of folded texts."""
    longest = F.greatest(F.length(left), F.length(right))
    return (
        F.when(left == right, F.lit(1.0))
        .when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0.0))
        .otherwise(1.0 - F.levenshtein(left, right) / longest)
    )


def _holds(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def question_type(folded: Column) -> Column:
    """The template that the wording follows, or null."""
    has = lambda x: F.contains(folded, F.lit(x))
    return (
        F.when(has("directly neighbor"), "direct").when(has("liked by both"), "comparison")
        .when(has("shortest path between"), "path").when(has("similar to") & has("two hops away"), "similarity")
    )


def rule_parameters(folded: Column, top_k: int = 10) -> Column:
    """struct(depth, decay, top_k) by the wording alone."""
    def value(depth: int, decay: float) -> Column:
        return F.struct(F.lit(depth).alias("depth"), F.lit(decay).alias("decay"), F.lit(top_k).alias("top_k"))

    between = F.concat(F.lit(" "), folded, F.lit(" "))
    return (
        F.when(_holds(folded, MULTI_HOP), value(3, 0.75)).when(_holds(folded, EXPLANATORY), value(2, 0.7))
        .when(_holds(between, COMPARISON), value(2, 0.6)).otherwise(value(1, 0.4))
    )


def heuristic_keywords(question: Column) -> Column:
    """Words of two letters or more that are no stop words, as they are written."""
    words = F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z'-]+"), F.lit(0))
    return F.filter(words, lambda x: ~F.lower(x).isin(*STOP))


def explicit_user_ids(question: Column) -> Column:
    """Numbered users that the question names outright; these override a model's keywords."""
    return F.regexp_extract_all(question, F.lit(r"(?iU)\bDeezer\s+user\s+\d+\b"), F.lit(0))


def numeric_id(node_id: Column) -> Column:
    """The number after an id's prefix."""
    return F.regexp_extract(node_id, r"_(\d+)$", 1).cast("long")


def prefixed(prefix: str, raw_id: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), raw_id.cast("string"))


def seeded_digest(seed: int, key: Column) -> Column:
    """Lower-case hex SHA-256 of "seed:key"; hex sorts as the bytes do."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256)


def blind_first(seed: int, key: Column) -> Column:
    """Which of two answers is shown first: the parity of the digest's first byte."""
    return F.conv(F.substr(seeded_digest(seed, key), F.lit(1), F.lit(2)), 16, 10).cast("int") % 2


def pair_id(seed: int, key: Column) -> Column:
    return F.substr(F.sha2(F.concat(F.lit(f"pair:{seed}:"), key).cast("binary"), 256), F.lit(1), F.lit(12))


def seeded_order(seed: int, key: Column, values: tuple[str, ...]) -> Column:
    """The values in an order that only seed and key decide (the standard library's shuffle)."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def ordered(keys: pa.Array) -> pa.Array:
        out = []
        for k in keys.to_pylist():
            own = list(values)
            random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest(), "big")).shuffle(own)
            out.append(own)
        return pa.array(out, pa.list_(pa.string()))

    return ordered(key)


#: Question templates by set and type; {a} and {b} are titles.
TEMPLATES = {
    "pages": {
        "direct": "Which pages directly neighbor {a}",
        "comparison": "Which pages are liked by both {a} and {b}",
        "path": "Which pages form the unique shortest path between {a} and {b}",
        "similarity": "Which pages similar to {a} share its category and are two hops away",
    },
}


def social_templates(entities: str, link: str) -> dict[str, str]:
    """The same for a social graph: entities and link in the plural, as users and follows."""
    return {
        "direct": f"Which {entities} have a direct {link[:-1]} with {{a}}",
        "comparison": f"Which {entities} have direct {link} with both {{a}} and {{b}}",
        "path": f"To get from {{a}} to {{b}} using the fewest {link}, which two {entities} do you pass through, in order",
        "similarity": f"Which {entities} are in the same dataset class as {{a}} and can be reached through exactly one intermediate {entities[:-1]}, but are not directly connected to {{a}}",
    }


def templated(template: str, a: Column, b: Column | None = None) -> Column:
    """The template with titles in place."""
    parts: list[Column] = []
    for n, piece in enumerate(re.split(r"(\{[ab]\})", template)):
        parts.append((a if piece == "{a}" else b) if n % 2 else F.lit(piece))
    return F.concat(*parts)
