"""Questions that arrive as a stream: each micro-batch is answered by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.plans import strategies
from wayfare.schema import QUESTIONS
from wayfare.sources.graph import Graph


def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, question) from JSON lines that appear in a folder."""
    return spark.readStream.schema(QUESTIONS).json(folder).select(F.col("id").alias("qid"), "question")


def answer_stream(graph: Graph, stream: DataFrame, out: str, checkpoint: str, strategy: str = "rules", trigger: dict | None = None, **options) -> StreamingQuery:
    """Appends results as JSON; a batch that is repeated after a failure replaces its own folder."""
    graph.keep("arcs", "totals", "titles")

    def batch(df: DataFrame, number: int) -> None:
        done = strategies.run(graph, df, strategy, **options)
        strategies.results(graph, df, strategy, done).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
