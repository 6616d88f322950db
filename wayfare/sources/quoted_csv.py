"""CSV whose quoted fields hold line ends, read by as many tasks as the file has splits.

A line end is inside a field if an odd number of quotes stands before it, so a split can't tell alone whether it begins
inside one. Three reads settle it, none of which moves a line: splits report whether they hold an odd number of
quotes; a prefix sum over these, a row a split, says how each begins; then every split cuts its lines into records, and
the pieces of records that cross the ends of splits, two a split at most, are put together.

Files as RFC 4180 has them: fields are quoted as a whole or not at all, quotes in them are doubled, records end with a line feed or
a carriage return and a line feed. Every file has the same header. Records keep the order of the files' names and of
their lines: _pos ascends with them, but is not dense. Blank lines are no records. Records of too many or too few fields raise, and so
does a field that never ends.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.sources.cut import kept

#: Records of a split: more than any split holds.
SPLIT = 1 << 33
WHOLE, BEGIN, MIDDLE, END = range(4)
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, path, split): the lines of each split in order; split is the byte where it begins."""
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))


def splits(lines: DataFrame) -> DataFrame:
    """(path, split, place, first, open): the place of a split in the order of files, whether it is its file's first, whether it begins inside a field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("path", "split").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("split")
    opens = F.coalesce(F.sum("odd").over(before.rowsBetween(Window.unboundedPreceding, -1)) % 2, F.lit(0))
    unended = F.sum("odd").over(Window.partitionBy("path")) % 2 == 1
    checked = F.when(unended, F.raise_error(F.concat(F.lit("a quoted field does not end in "), "path"))).otherwise(opens)
    # one row a split: 800,000 of them are 100 TB
    place = F.row_number().over(Window.orderBy("path", "split")) - 1
    return odd.select("path", "split", place.alias("place"), (F.row_number().over(before) == 1).alias("first"), (checked == 1).alias("open"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _pos): the lines of text files by as many tasks as they have splits; _pos ascends with files' names and lines."""
    lines = _lines(spark, path)
    known = lines.select("path", "split").distinct()
    known = kept(known.withColumn("place", F.row_number().over(Window.orderBy("path", "split")) - 1))
    # rows of a task are numbered as they come, those of one split in their order
    nth = F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT))
    return lines.withColumn("_nth", nth).join(F.broadcast(known), ["path", "split"]).select("value", (F.col("place") * SPLIT + F.col("_nth")).alias("_pos"))


def _cut(batches, whole: bool):
    """(place, nth, kind, text) of lines in order with their split's place and whether it opens inside a field: its records, or the pieces at its ends."""
    place, inside, begun, nth = None, False, False, 0
    held: list[str] = []

    def rows(kinds, numbers, texts):
        chosen = [i for i, k in enumerate(kinds) if (k == WHOLE) == whole]
        take = pa.array(chosen, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([place] * len(chosen), pa.int64()), pa.array(numbers, pa.int64()).take(take), pa.array(kinds, pa.int32()).take(take), texts.take(take)], ["place", "nth", "kind", "text"])

    def close():
        if held:
            yield rows([BEGIN if begun else MIDDLE], [nth], pa.array(["\n".join(held)], pa.string()))

    for batch in batches:
        where = batch["place"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if where[a] != place:
                yield from close()
                place, nth, held = int(where[a]), 0, []
                inside = batch["open"][a].as_py()
                begun = not inside
            values = batch["value"].slice(a, b - a)
            odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
            after = (int(inside) + np.cumsum(odd)) % 2
            ends = np.flatnonzero(after == 0) + 1
            inside = bool(after[-1])
            if len(ends):
                lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), values.slice(0, int(ends[-1])))
                texts = pc.binary_join(lists, "\n")
                kinds = [WHOLE if begun else END] + [WHOLE] * (len(ends) - 1)
                if held:
                    first = "\n".join([*held, texts[0].as_py()])
                    texts = pa.concat_arrays([pa.array([first], pa.string()), texts.slice(1)])
                yield rows(kinds, range(nth, nth + len(ends)), texts)
                nth, held, begun = nth + len(ends), [], True
            held = held + values.slice(int(ends[-1]) if len(ends) else 0).to_pylist()
    yield from close()


_PIECE = "place long, nth long, kind int, text string"


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(place, nth, text, first): every record whole, blank ones left out; first tells whether its split is a file's first."""
    lines = _lines(spark, path)
    known = kept(splits(lines))
    # a broadcast join keeps the lines where they are, in order
    own = lines.join(F.broadcast(known), ["path", "split"]).select("value", "place", "open")
    whole = own.mapInArrow(lambda b: _cut(b, True), _PIECE).select("place", "nth", "text")
    pieces = own.mapInArrow(lambda b: _cut(b, False), _PIECE)
    # a record's pieces follow each other: one that begins it, those of splits inside it, one that ends it
    order = Window.orderBy("place", "nth", "kind")
    joined = pieces.withColumn("record", F.sum((F.col("kind") == BEGIN).cast("int")).over(order)).groupBy("record")
    piece = F.array_sort(F.collect_list(F.struct("place", "nth", "text")))
    joined = joined.agg(piece.alias("p")).select(F.col("p")[0]["place"].alias("place"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = whole.unionByName(joined).join(F.broadcast(known.select("place", "first")), "place")
    return every.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files' columns as text, null where a field is empty, and _pos."""
    found = records(spark, path)
    mark = F.regexp_replace("text", "^\ufeff", "")
    heads = [r["text"] for r in found.where("first and nth = 0").select(mark.alias("text")).distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"the files of {path} have different headers" if heads else f"{path} has no header")
    names = next(csv.reader(io.StringIO(heads[0], newline="")))
    if len({n.lower() for n in [*names, "_pos"]}) <= len(names):
        raise ValueError(f"{path} repeats a column: {names}")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = found.where("not (first and nth = 0)").select(F.from_csv("text", F.lit(kind.toDDL()), OPTIONS).alias("r"), (F.col("place") * SPLIT + F.col("nth") - F.col("first").cast("int")).alias("_pos"))
    return rows.select("r.*", "_pos")
