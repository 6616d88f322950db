"""What several operators share: the shared folder, size-checked joins, bounded pair blocks, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that may be broadcast; above it a join shuffles. 500,000 rows of 16 bytes are 8 MB.
BROADCAST_ROWS = 500_000
#: Bytes of a broadcast table's strings and arrays.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one only where master is local and that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and root.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        root = default.rstrip("/") + root if not default.startswith("file:") else f"file://{root}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def long_texts(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default: whole documents are wide rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


#: Spark's setting by which a query removes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors, and frees the shuffles before it."""
    spark = df.sparkSession
    path, before = shared_dir(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, bound: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """The (materialised) table, marked for broadcast only if its counted rows keep to the bound.

    weight: the bytes of a row's parts that have no fixed size; their sum must keep to BROADCAST_BYTES too.
    """
    if df.limit(bound + 1).count() > bound:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def sided(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The (materialised) table as a side of a join: broadcast if its counted rows keep to the bound, else merged, whatever its files' size.

    Numbers that repeat are a small part of their size in files and in shuffles, by which Spark would decide, so large tables would be broadcast.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df.hint("merge")


def own_keys(df: DataFrame, id_col: str, content: list[str], label: str, key: str = "key") -> tuple[DataFrame, DataFrame | None]:
    """The rows with a column `key`, a long that no other row has, and (key, id) of all rows, or None where the key is the id.

    Where ids are unique and not null they are the keys and no row moves. Else rows are sorted by id (nulls last), rows that
    share an id by a hash of their content, and numbered in that order as they are written, so that keys ascend with ids.
    """
    shared = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1))
    if shared.isEmpty():
        return df.withColumn(key, F.col(id_col).cast("long")), None
    order = [F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*content)]
    written = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), label)
    return written, written.select(F.col(key).alias("key"), F.col(id_col).alias("id"))


def pair_blocks(df: DataFrame, key: list[str], member: str, limit: int, needs: str = "true") -> DataFrame:
    """Deals each group of `key` into chunks of about `limit` members and every pair of chunks to one (chunk_i, chunk_j) block.

    A later grouping by key, chunk_i and chunk_j sees two chunks at most, however large the group is, and each pair of
    members in exactly one block. Adds chunk, chunk_i and chunk_j; groups of one member are dropped, as they hold no pair,
    and so are those for which the SQL aggregate `needs` is false.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.expr(needs).alias("_needs")).where("_size > 1 and _needs").drop("_needs")
    pairs = "transform(sequence(0, _chunks - 1), k -> named_struct('i', least(_chunk, k), 'j', greatest(_chunk, k)))"
    return (
        df.join(sizes, key)
        .withColumn("_chunks", F.ceil(F.col("_size") / limit).cast("int"))
        .withColumn("_chunk", F.expr(f"cast(pmod(xxhash64({member}, 17L), _chunks) as int)"))
        .withColumn("_pair", F.explode(F.expr(pairs)))
        .withColumns({"chunk": F.col("_chunk"), "chunk_i": F.col("_pair.i"), "chunk_j": F.col("_pair.j")})
        .drop("_size", "_chunks", "_chunk", "_pair")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(v, component) for every vertex of the edges (a, b), longs; component is the smallest vertex reachable.

    Each round contracts: every vertex goes to the one of itself and its neighbours that is first in an order drawn anew
    by hash, and edges follow their ends, until none is left. The last vertex in that order that has an edge always goes,
    so the rounds end; in expectation a quarter goes at least, whatever the ids and the shape, so they are logarithmic in the vertices.
    Each round is written to the shared folder. No vertex that has no edge is returned.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, f"{label}-edges")
    rounds: list[DataFrame] = []
    while not rounds or not both.isEmpty():
        drawn = lambda v: F.struct(F.xxhash64(v, F.lit(len(rounds))).alias("h"), F.col(v).alias("v"))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("v"), F.least("near", drawn("a"))["v"].alias("to"))
        first = materialise(first, f"{label}-{len(rounds)}")
        rounds.append(first)
        goes = sided(first)
        moved = both.join(goes, both.a == first.v).select(F.col("to").alias("a"), "b")
        moved = moved.join(goes, moved.b == first.v).select("a", F.col("to").alias("b"))
        both = materialise(moved.where("a <> b").distinct(), f"{label}-edges-{len(rounds)}")
    # from the last round back: where a vertex's choice went in the end
    state = rounds.pop()
    while rounds:
        later = sided(state.select(F.col("v").alias("to"), F.col("to").alias("end")))
        state = materialise(rounds.pop().join(later, "to", "left").select("v", F.coalesce("end", "to").alias("to")), f"{label}-back-{len(rounds)}")
    least = state.groupBy("to").agg(F.min("v").alias("component"))
    return materialise(state.join(least.hint("merge"), "to").select("v", "component"), f"{label}-components")
