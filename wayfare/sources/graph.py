"""Property graphs as DataFrames: loading, validation, derived tables."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.text import trigrams, with_folded
from wayfare.schema import NODES
from wayfare.sources.cut import kept
from wayfare.sources.quoted_csv import read_quoted_csv


def require_columns(df: DataFrame, required: set[str], name: str) -> DataFrame:
    if missing := required - set(df.columns):
        raise ValueError(f"{name} is missing columns: {sorted(missing)}")
    return df


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """Adds the place of each row of files that are read whole by one task: files by name, rows as they stand in them."""
    place, paths = F.monotonically_increasing_id(), sorted(df.inputFiles())
    if len(paths) < 2:
        return df.withColumn(name, place)
    order = df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "_path string, _file long")
    found = df.withColumns({"_path": F.input_file_name(), "_row": place % (1 << 33)}).join(F.broadcast(order), "_path", "left")
    number = F.when(F.col("_file").isNull(), F.raise_error(F.lit("a row of no known file"))).otherwise(F.col("_file") * (1 << 33) + F.col("_row"))
    return found.withColumn(name, number).drop("_path", "_file", "_row")


def ranked_by(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the rank of each row by a column, from 1, without a task that sees all rows: ranges are sorted apart, and a row each is summed up."""
    at = F.col("_at")
    own = kept(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    held = own.groupBy(F.shiftright(at, 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_range", before.alias("_before"))
    found = own.withColumn("_range", F.shiftright(at, 33)).join(F.broadcast(held), "_range")
    return found.withColumn(name, F.col("_before") + at % (1 << 33) + 1).drop("_range", "_before", "_at")


class Graph:
    """Nodes (id, title, description, pos) and edges (source, target, weight, description, pos).

    pos is the order of loading. Derived tables are lazy; keep() persists those that every query joins, spilling to
    disk, and save() writes them as bucketed tables for clusters that share a warehouse.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    # ---- loading -------------------------------------------------------------------------------------------------

    @classmethod
    def from_csv(cls, spark: SparkSession, nodes_path: str, edges_path: str, validate: bool = True) -> Graph:
        """Reads two CSV files, or folders of them, with headers: id, title[, description] and source, target[, weight, description].

        Fields may hold line ends; files are read by as many tasks as they have splits (see quoted_csv).
        """
        nodes = require_columns(read_quoted_csv(spark, nodes_path), {"id", "title"}, nodes_path)
        edges = require_columns(read_quoted_csv(spark, edges_path), {"source", "target"}, edges_path)
        if "description" not in nodes.columns:
            nodes = nodes.withColumn("description", F.lit(""))
        if "description" not in edges.columns:
            edges = edges.withColumn("description", F.lit(""))
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        nodes = nodes.select("id", "title", F.coalesce("description", F.lit("")).alias("description"), F.col("_pos").alias("pos"))
        weight = F.when(F.col("weight").isNull(), F.raise_error(F.lit("an edge has an empty weight"))).otherwise(F.col("weight").cast("double"))
        edges = edges.select("source", "target", weight.alias("weight"), F.coalesce("description", F.lit("")).alias("description"), F.col("_pos").alias("pos"))
        # a repeated id keeps its last row's values at its first row's place
        nodes = nodes.groupBy("id").agg(F.max_by("title", "pos").alias("title"), F.max_by("description", "pos").alias("description"), F.min("pos").alias("pos"))
        graph = cls(nodes, edges)
        return graph.validated() if validate else graph

    @classmethod
    def from_rows(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
        """Nodes (id, title, description) and edges (source, target, weight, description), in order."""
        n = spark.createDataFrame([(*x, i) for i, x in enumerate(nodes)], [*NODES.names, "pos"] if nodes else "id string, title string, description string, pos long")
        e = spark.createDataFrame([(*x, i) for i, x in enumerate(edges)], "source string, target string, weight double, description string, pos long")
        return cls(n, e)

    def validated(self) -> Graph:
        """Rejects edges whose endpoints are no nodes."""
        if unknown := [r["id"] for r in self.unknown_endpoints().orderBy("id").limit(1001).collect()]:
            raise ValueError(f"Edges refer to unknown node IDs: {unknown[:1000]}" + " and more" * (len(unknown) > 1000))
        return self

    def ends(self, edges: DataFrame) -> DataFrame:
        """(id) of the ends of edges, each once; in the session's own number of parts, as ids shrink so far in a shuffle that few tasks would get them all."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return edges.select(F.explode(F.array("source", "target")).alias("id")).repartition(parts, "id").distinct()

    def unknown_endpoints(self) -> DataFrame:
        """(id) of ends that are no nodes; sorted and merged, as files tell too little of a nodes table's size to broadcast it by that."""
        return self.ends(self.edges).join(self.nodes.select("id").hint("merge"), "id", "left_anti")

    def not_unit(self) -> DataFrame:
        return self.edges.where("weight <> 1.0")

    def require_unit_weights(self) -> None:
        if not self.not_unit().limit(1).isEmpty():
            raise ValueError("this operator requires an unweighted graph")

    def require_no_isolated(self) -> None:
        """The sampled query type has no place for nodes without neighbours."""
        if not self.isolated().limit(1).isEmpty():
            raise ValueError("query type S rejects isolated vertices")

    # ---- derived tables ------------------------------------------------------------------------------------------

    def both_ways(self, edges: DataFrame, *columns: str) -> DataFrame:
        """(src, dst, columns): edges in both directions, read once, in the session's own number of parts by source: joins by source leave them there."""
        one = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *columns)
        both = edges.select(F.inline(F.array(one("source", "target"), one("target", "source"))))
        return both.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "src")

    @cached_property
    def arcs(self) -> DataFrame:
        """(src, dst, weight): what walks go along, usable edges in both directions; parallel ones stay apart, as sums over targets don't need them summed."""
        return self.both_ways(self.edges.where("source <> target and weight > 0"), "weight")

    @cached_property
    def totals(self) -> DataFrame:
        """(id, total): the weight of all arcs out of a node."""
        return self.arcs.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"))

    @cached_property
    def transition(self) -> DataFrame:
        """(src, dst, weight, share): parallel edges summed, both directions; share is the part of the source's weight."""
        # dealt by source once: sums, totals and later joins by source leave the rows where they are
        summed = self.arcs.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        return summed.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src")))

    @cached_property
    def simple_edges(self) -> DataFrame:
        """(a, b): each undirected edge once, no self-loops, a the smaller id as text."""
        return self.edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    @cached_property
    def adjacency(self) -> DataFrame:
        """(src, dst): the simple graph in both directions."""
        return self.both_ways(self.edges.where("source <> target")).distinct()  # dealt as arcs are

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree): numbers of distinct neighbours, without nodes that have none."""
        return self.adjacency.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    @cached_property
    def biased(self) -> DataFrame:
        """(src, dst, src_degree, dst_degree): what every (a, b) pair's factor is made of; dealt by source, as arcs are."""
        # an arc's reverse is an arc too, so its source's degree, which is where the arc is, goes with it to where it is the target's: nothing is dealt by target
        degree = lambda name: self.degrees.select(F.col("id").alias("src"), F.col("degree").alias(name))
        back = self.adjacency.join(degree("dst_degree"), "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dst_degree")
        back = back.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "src")
        return back.join(degree("src_degree"), "src").select("src", "dst", "src_degree", "dst_degree")

    def isolated(self) -> DataFrame:
        """(id) of nodes that no edge joins with another; edges are asked as they are, without the adjacency."""
        return self.nodes.select("id").join(self.ends(self.edges.where("source <> target")), "id", "left_anti")

    @cached_property
    def titles(self) -> DataFrame:
        """(norm, node_id, title): of equal folded titles the last node is found and the first is shown."""
        folded = with_folded(self.nodes.select("id", "title", "pos"), "title", "norm")
        return folded.groupBy("norm").agg(F.max_by("id", "pos").alias("node_id"), F.min_by("title", "pos").alias("title"))

    @cached_property
    def mention_index(self) -> DataFrame:
        """(mark, norm, offset, size): the word under which mentions of a title are sought."""
        from wayfare.operators.matching import title_marks

        return title_marks(self)

    @cached_property
    def postings(self) -> DataFrame:
        """(gram, norm, n_grams): the trigram index of the titles."""
        grams = self.titles.select("norm", trigrams(F.col("norm")).alias("grams"))
        return grams.select(F.explode("grams").alias("gram"), "norm", F.size("grams").alias("n_grams"))

    @cached_property
    def gram_counts(self) -> DataFrame:
        """(gram, titles): how many titles hold a trigram."""
        return self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))

    def keep(self, *names: str) -> Graph:
        """Persists derived tables, as arcs, totals, adjacency, biased, titles, postings."""
        for name in names:
            getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        """Gives back what keep() persisted."""
        for name in ("arcs", "totals", "transition", "adjacency", "biased", "titles", "postings", "gram_counts", "mention_index", "degrees"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    def save(self, prefix: str, buckets: int = 200) -> None:
        """Bucketed tables of the warehouse, so that propagation joins without moving the graph."""
        for name in ("transition", "biased"):
            getattr(self, name).write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").saveAsTable(f"{prefix}_{name}")

    @classmethod
    def saved(cls, spark: SparkSession, prefix: str, nodes: DataFrame, edges: DataFrame) -> Graph:
        graph = cls(nodes, edges)
        transition = spark.table(f"{prefix}_transition")
        graph.__dict__ |= {"transition": transition, "arcs": transition.select("src", "dst", "weight"), "biased": spark.table(f"{prefix}_biased")}
        return graph

    def views(self, prefix: str = "graph") -> None:
        """Temporary views for SQL."""
        for name in ("nodes", "edges", "adjacency", "transition", "degrees", "titles"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}_{name}")


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The driver's tables as a graph: regions, nations, customers, suppliers, parts; an edge for each line of an order.

    Orders give parallel edges between customer and part, and lines between part and supplier, each of weight 1.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = (("r", "region", "r_regionkey", "r_name"), ("n", "nation", "n_nationkey", "n_name"), ("c", "customer", "c_custkey", "c_name"), ("s", "supplier", "s_suppkey", "s_name"), ("p", "part", "p_partkey", "p_name"))
    nodes = None
    for n, (short, name, key, title) in enumerate(kinds):
        own = read(name).select(
            F.concat(F.lit(short), F.col(key).cast("string")).alias("id"), F.col(title).alias("title"), F.lit(name).alias("description"),
            (F.lit(n * 10**12) + F.col(key)).cast("long").alias("pos"),
        )
        nodes = own if nodes is None else nodes.unionAll(own)
    node = lambda short, key: F.concat(F.lit(short), F.col(key).cast("string"))

    def edges_of(df: DataFrame, a: tuple[str, str], b: tuple[str, str], label: str, n: int, order: str) -> DataFrame:
        return df.select(node(*a).alias("source"), node(*b).alias("target"), F.lit(1.0).alias("weight"), F.lit(label).alias("description"), (F.lit(n * 10**15) + F.expr(order)).cast("long").alias("pos"))

    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = read("orders").select("o_orderkey", "o_custkey")
    bought = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    edges = edges_of(read("nation"), ("n", "n_nationkey"), ("r", "n_regionkey"), "in", 0, "n_nationkey")
    edges = edges.unionAll(edges_of(read("customer"), ("c", "c_custkey"), ("n", "c_nationkey"), "of", 1, "c_custkey"))
    edges = edges.unionAll(edges_of(read("supplier"), ("s", "s_suppkey"), ("n", "s_nationkey"), "of", 2, "s_suppkey"))
    edges = edges.unionAll(edges_of(lines, ("p", "l_partkey"), ("s", "l_suppkey"), "from", 3, "l_orderkey * 1000 + l_linenumber"))
    edges = edges.unionAll(edges_of(bought, ("c", "o_custkey"), ("p", "l_partkey"), "bought", 4, "l_orderkey * 1000 + l_linenumber"))
    return Graph(nodes, edges)
