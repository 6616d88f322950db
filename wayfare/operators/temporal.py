"""Joins along time: the last row before each row, and points in intervals. Both cut time into buckets, so a key that holds
very many rows is many groups, and nothing compares all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.schema import above_zero


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], *, strict: bool = True, bucket_seconds: int = 86_400) -> DataFrame:
    """The rows of `left` with the `values` of the right row of their key that is the last before their time, null where there is none.

    strict: earlier; else earlier or at the same time. Of right rows of one time the one of the greatest values counts. Left rows
    without key or time have none, right ones are none's. Within a bucket of time the last row is carried along; what stands before a
    bucket comes from the buckets' own last rows, one a bucket.
    """
    above_zero("bucket_seconds", bucket_seconds)
    found = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.struct(*values).alias("_value"))
    found = found.withColumn("_bucket", _bucket(F.col("_time"), bucket_seconds))
    own = left.withColumns({"_key": F.col(key), "_time": F.col(time), "_bucket": _bucket(F.col(time), bucket_seconds), "_row": F.struct(*left.columns)})
    # a left row before right ones of its time, or after them
    side = F.lit(0 if strict else 2)
    rows = own.select("_key", "_bucket", "_time", side.alias("_side"), F.lit(None).cast(found.schema["_value"].dataType).alias("_value"), "_row")
    rows = rows.unionByName(found.select("_key", "_bucket", "_time", F.lit(1).alias("_side"), "_value", F.lit(None).cast(own.schema["_row"].dataType).alias("_row")))
    within = Window.partitionBy("_key", "_bucket").orderBy("_time", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(within)).where("_side <> 1")
    lasts = rows.groupBy("_key", "_bucket").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_time", "_value")))["_value"].alias("_last"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("_key", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = near.join(lasts, ["_key", "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_carried"))
    return joined.select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, time: str, begin: str, end: str, *, bucket_seconds: int = 3600) -> DataFrame:
    """Every point (key, time, ...) with every interval (key, begin, end, ...) of its key that holds it: begin <= time < end.

    Other columns of both must differ. An interval stands in each bucket of time that it meets, a point in one. Nulls in key, time,
    begin or end hold nothing, and neither do intervals that end before they begin. Intervals much longer than a bucket are repeated often.
    """
    above_zero("bucket_seconds", bucket_seconds)
    if clash := (set(points.columns) & set(intervals.columns)) - {key}:
        raise ValueError(f"both sides have {sorted(clash)}")
    # the end itself is outside
    last = F.floor((F.unix_micros(F.col(end).cast("timestamp")) - 1) / (bucket_seconds * 1_000_000)).cast("long")
    spread = intervals.where(F.col(begin) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(begin), bucket_seconds), last)))
    own = points.withColumn("_bucket", _bucket(F.col(time), bucket_seconds))
    return own.join(spread, [key, "_bucket"]).where((F.col(begin) <= F.col(time)) & (F.col(time) < F.col(end))).drop("_bucket")
