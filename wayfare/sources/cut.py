"""Cutting lineage: a table that several results read is computed once, and its plan ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a query removes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of this machine only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="wayfare-")


def scratch(spark: SparkSession, label: str) -> str:
    """A path for a new folder there."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The table, written to the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table, written as files there and read again. A checkpoint keeps what is known of its rows, such as which columns are equal or not null; from
    round to round of a loop of joins that doubles, and the driver soon does nothing else than plan. Files keep nothing, and the shuffles before them are removed."""
    spark = df.sparkSession
    path, before = scratch(spark, "written"), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
