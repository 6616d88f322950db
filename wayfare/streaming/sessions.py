"""Sessions of keyed events that arrive as a stream, with a rule for late rows; the same plan takes a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, time: str, value: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, begin, end, events, total): runs of a key's events that are less than `gap` apart; end is the last event's time and the gap.

    As a stream, a session is given once the watermark, the latest time seen less `late`, has passed its end; rows that alone would
    have ended before the watermark with which the batch before began are dropped, and all others are counted, in whatever order they
    come. As a table, all sessions are given.
    """
    own = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key), F.col(time).cast("timestamp").alias("_at"), F.col(value).alias("_value"))
    if events.isStreaming:
        own = own.withWatermark("_at", late)
    found = own.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("_value").alias("total"))
    return found.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "total")


def event_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    """Events from Parquet files that appear in a folder, in the order of their appearance."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def session_stream(stream: DataFrame, out: str, checkpoint: str, key: str, time: str, value: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Appends each session once to a folder of Parquet files; Spark's log of the sink makes a repeated batch harmless."""
    writer = sessions(stream, key, time, value, **options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)
