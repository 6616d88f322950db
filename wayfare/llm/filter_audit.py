"""Filter interaction audit: what every order of several filters keeps, removes and loses, by one pass over the texts.

Each row fails a set of filters, a mask of bits. By part and label the signed parity sums of the masks are aggregated (the
Walsh-Hadamard spectrum: 32 sums for five filters), however many rows there are; its exact inverse gives the number of rows
of every mask, and from these cells come all steps of all orders and each filter's Shapley share: a row that fails k filters
is removed by each of them in (number of orders) / k orders.

Copies are a filter too: a row fails it if the same text has a smaller id anywhere in the table. Rows of one text differ in
part, label and id only, so they are counted by text before anything is compared, and no row meets another.

Null texts are empty texts, a null part is the part ''. A null id is smaller than none and larger than none, so such a row is
no copy and makes none; rows that share an id don't make copies of each other, whatever their texts. Every row counts, also
repeated ones. Labels of a repeated id hold if any of its rows says so; null labels and labels of unknown ids say nothing. Very
long texts are split whole, one at a time. An empty table has no parts and gives no rows. Further columns are ignored,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Labels in the order of their columns: all rows, rows of quality 1, rows of toxic 1.
LABELS = ("all", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of anything but spaces and line ends."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def too_short(text: Column) -> Column:
    return F.size(words(text)) < 100


def repetitive(text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < 80 * F.size(words(text))


def shouting(text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text)


def odd_signs(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters by letter: the condition under which a text fails. Copies come after them.
FILTERS: dict[str, Callable[[Column], Column]] = {"A": too_short, "B": repetitive, "C": shouting, "D": odd_signs}
COPIES = "E"


def failures(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, Callable[[Column], Column]] = FILTERS) -> DataFrame:
    """(id, part, digest, mask) of every row; the k-th filter is the k-th bit, digest names the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(fails(F.col("text")), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def masks(failed: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic", filters: int = len(FILTERS)) -> DataFrame:
    """(part, good, toxic, mask, n) of failures(): labels joined, the bit of copies set after those of the filters, rows counted.

    Rows are counted by id and text, then by text, so that a text's many copies leave each task as one row.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(good_col) == 1).alias("good"), F.max(F.col(toxic_col) == 1).alias("toxic"))
    counted = failed.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    own = counted.join(said, F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    named = F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0))
    # an id occurs once in each of these groups, so min_by gives how many rows have the smallest
    texts = own.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), named.alias("named"), F.min("id").alias("own"), F.min_by("n", "id").alias("first"))
    # written, as it is joined with itself: the documents are read once
    texts = materialise(texts, "audited-texts")
    least = texts.groupBy("digest").agg(F.min("own").alias("least"))
    copies = F.col("named") - F.when(F.col("own") == F.col("least"), F.col("first")).otherwise(0)
    found = texts.join(least, "digest").select("part", "good", "toxic", "mask", "n", copies.alias("copies"))
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << filters)).alias("mask"), F.col("copies").alias("n")))
    return found.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def spectrum(counted: DataFrame, filters: int) -> DataFrame:
    """(part, label, sums): for every set of filters the rows that fail an even number of it less those that fail an odd number."""
    own = F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    rows = counted.select("part", F.explode(own).alias("label"), "mask", "n").where("label is not null")
    sums = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(s)) % 2 == 0, F.col("n")).otherwise(-F.col("n"))) for s in range(1 << filters)]
    return rows.groupBy("part", "label").agg(F.array(*sums).alias("sums"))


def cells(spectra: DataFrame, filters: int) -> DataFrame:
    """(part, all, good, toxic): for each label the rows of every mask, the transform's exact inverse."""
    size = 1 << filters
    inverse = f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, (a, s) -> a + if(bit_count(m & s) % 2 = 0, sums[s], -sums[s])) div {size})"
    none = F.array_repeat(F.lit(0).cast("long"), size)
    found = spectra.select("part", "label", F.expr(inverse).alias("n"))
    return found.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == label, F.col("n"))), none).alias(label) for label in LABELS])


def orders(parts: DataFrame, letters: str) -> DataFrame:
    """What every step of every order of the filters does, from cells(): a row per part, order and step."""
    size = 1 << len(letters)
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit = lambda letter: f"shiftleft(1, instr('{letters}', {letter}) - 1)"
    steps = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("own", F.expr(bit("substring(filter_order, step, 1)")))
    steps = steps.withColumn("before", F.expr(f"aggregate(split(substring(filter_order, 1, step - 1), ''), 0, (a, x) -> if(x = '', a, a | {bit('x')}))"))
    total = lambda label, when, n="{}[m]": F.expr(f"aggregate(sequence(0, {size - 1}), 0L, (a, m) -> if({when}, a + {n.format(f'`{label}`')}, a))")
    here = "m & own > 0 and m & before = 0"
    share = f"{{}}[m] * {factorial(len(letters))} div bit_count(m)"
    return steps.select(
        "part", "filter_order", "step", total("all", "m & (own | before) = 0").alias("kept"), total("all", here).alias("removed"), total("all", "m & own > 0 and m & before > 0").alias("redundant"),
        total("all", "m = own").alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("all", "m & own > 0", share).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, Callable[[Column], Column]] = FILTERS, copies: str = COPIES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    The filters are single letters, `copies` the letter of the filter for copies. Orders are all permutations of the letters,
    so a handful of filters is meant.
    """
    letters = "".join(filters) + copies
    if len(set(letters)) != len(filters) + 1 or len(letters) > 7 or not letters.isalnum():
        raise ValueError("filters need single letters of their own, seven with the copies' at most")
    counted = masks(failures(documents, id_col=id_col, text_col=text_col, part_col=part_col, filters=filters), labels, id_col=id_col, filters=len(filters))
    return orders(cells(spectrum(counted, len(letters)), len(letters)), letters)


def _oracle() -> str:
    """DuckDB: the failures of every row, and every step of every order from the rows' masks."""
    steps = [("".join(p), n + 1, 1 << (ord(p[n]) - 65), sum(1 << (ord(x) - 65) for x in p[:n])) for p in permutations("ABCDE") for n in range(5)]
    values = ", ".join(f"('{o}', {n}, {own}, {before})" for o, n, own, before in steps)
    return rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') as w from d),
f as (select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(min(doc_id) over (partition by t) < doc_id, false)::int as m from w),
l as (select part, m, count(*) as n, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as good, count(*) filter (doc_id in (select doc_id from labels where toxic = 1)) as toxic from f group by all),
s(filter_order, step, own, before) as (values {values}),
x as (select part, filter_order, step, cast(coalesce(sum(n) filter (m & (own | before) = 0), 0) as bigint) as kept, cast(coalesce(sum(n) filter (m & own > 0 and m & before = 0), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (m & own > 0 and m & before > 0), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (m = own), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (m & own > 0 and m & before = 0), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (m & own > 0 and m & before = 0), 0) as bigint) as toxic_lost from l cross join s group by all)
select *, cast(sum(removed) over (partition by part, substring(filter_order, step, 1)) as bigint) as shapley from x"""


ORACLE = _oracle()
