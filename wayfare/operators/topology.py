"""Topology of the simple graph, by joins: common neighbours, distance two, unique three-edge paths, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.text import with_folded
from wayfare.sources.cut import written
from wayfare.sources.graph import Graph


def common_neighbours(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(qid, node_id): nodes adjacent to both a and b of (qid, a, b)."""
    adj = graph.adjacency
    left = pairs.join(adj, F.col("a") == F.col("src")).select("qid", "b", F.col("dst").alias("node_id"))
    return left.join(adj.select(F.col("src").alias("b"), F.col("dst").alias("node_id")), ["b", "node_id"], "left_semi").select("qid", "node_id")


def distance_two(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(qid, node_id): nodes that a shortest path of exactly two edges reaches from the seed of (qid, seed)."""
    adj = graph.adjacency
    one = seeds.join(adj, F.col("seed") == F.col("src")).select("qid", "seed", F.col("dst").alias("mid"))
    two = one.join(adj, F.col("mid") == F.col("src")).where("dst <> seed").select("qid", F.col("dst").alias("node_id")).distinct()
    near = one.select("qid", F.col("mid").alias("node_id"))
    return two.join(near, ["qid", "node_id"], "left_anti").select("qid", "node_id")


#: Parts of the seeds that share a middle and a category: what is behind the middle goes to each of them.
DEALT = 8


def same_category_distance_two(graph: Graph, seeds: DataFrame, categories: DataFrame) -> DataFrame:
    """The same, only nodes of the seed's category; categories: (id, category).

    The second edge is joined by its middle and the wanted category, so nodes of other categories are never paired. A seed of one
    neighbour reaches a node by it alone, and nothing behind it is the neighbour: such pairs, which may be very many, are neither
    moved nor sorted once they meet.
    """
    adj = graph.adjacency
    own = seeds.join(categories, F.col("seed") == F.col("id")).select("qid", "seed", F.col("category").alias("wanted"))
    one = own.join(adj, F.col("seed") == F.col("src")).select("qid", "seed", "wanted", F.col("dst").alias("mid"))
    # a question is told by its id alone, as several seeds of one are one question's
    by = Window.partitionBy("qid")
    one = written(one.distinct().withColumn("n", F.count(F.lit(1)).over(by)))
    ends = categories.select(F.col("id").alias("node_id"), F.col("category").alias("wanted")).distinct()
    second = adj.join(ends, F.col("dst") == F.col("node_id")).select(F.col("src").alias("mid"), "wanted", "node_id")
    # few keys make very many pairs, so a key's seeds are dealt out
    dealt = one.where("n = 1").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(DEALT)).cast("int"))
    copied = second.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    sure = dealt.hint("shuffle_hash").join(copied, ["mid", "wanted", "part"]).where("node_id <> seed").select("qid", "node_id")
    several = one.where("n > 1")
    # few rows make very many, so they are dealt to all tasks before they meet
    two = several.repartition(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), "qid").join(second, ["mid", "wanted"]).where("node_id <> seed").select("qid", "node_id").distinct()
    return sure.unionByName(two.join(several.select("qid", F.col("mid").alias("node_id")), ["qid", "node_id"], "left_anti"))


def unique_three_hop_path(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(qid, left, right): the only path start, left, right, target, where start and target are further than two apart.

    What lies between a neighbour of a start and a target is counted once for both, however many starts share the neighbour.
    """
    adj = graph.adjacency
    apart = pairs.join(adj, (F.col("start") == F.col("src")) & (F.col("target") == F.col("dst")), "left_anti")
    shared = common_neighbours(graph, apart.select("qid", F.col("start").alias("a"), F.col("target").alias("b"))).select("qid").distinct()
    apart = apart.join(shared, "qid", "left_anti")
    left = apart.join(adj, F.col("start") == F.col("src")).select("qid", F.col("dst").alias("left"), "target")
    ends = left.select("left", "target").distinct().select(F.struct("left", "target").alias("qid"), F.col("left").alias("a"), F.col("target").alias("b"))
    # start and target are not adjacent, so none of these is the start, and no left is the target
    between = common_neighbours(graph, ends).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("right")).select("qid.*", "n", "right")
    paths = left.join(between, ["left", "target"]).groupBy("qid").agg(F.sum("n").alias("n"), F.min("left").alias("left"), F.min("right").alias("right"))
    return paths.where("n = 1").select("qid", "left", "right")


def canonical_edges(raw: DataFrame, first: str, second: str) -> DataFrame:
    """(a, b): numeric undirected pairs, smaller id first, without self-loops and repeats."""
    a, b = F.col(first).cast("long"), F.col(second).cast("long")
    return raw.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def unique_titles(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, title): of equal folded names the best connected node (then the smallest id) keeps it; others get " [page ID]".

    nodes: (id long, name); degrees: (id long, degree), absent ones 0.
    """
    named = with_folded(nodes.select("id", "name"), "name", "norm").join(degrees, "id", "left")
    order = Window.partitionBy("norm").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id")
    kept = F.trim("name")
    title = F.when(F.row_number().over(order) == 1, kept).otherwise(F.concat(kept, F.lit(" [page "), F.col("id").cast("string"), F.lit("]")))
    return named.select("id", title.alias("title"))


def require_unique(titles: DataFrame) -> DataFrame:
    folded = with_folded(titles, "title", "norm")
    if not folded.groupBy("norm").count().where("count > 1").limit(1).isEmpty():
        raise ValueError("titles are not unique")
    return titles


def expected_labels(graph: Graph, questions: DataFrame, categories: DataFrame) -> DataFrame:
    """(qid, node_id) that the question's type and seeds require; questions: (qid, question_type, seeds)."""
    a, b = F.col("seeds")[0], F.get("seeds", F.lit(1))
    of = lambda kind: questions.where(F.col("question_type") == kind)
    direct = of("direct").select("qid", a.alias("a")).join(graph.adjacency, F.col("a") == F.col("src")).select("qid", F.col("dst").alias("node_id"))
    comparison = common_neighbours(graph, of("comparison").select("qid", a.alias("a"), b.alias("b")))
    path = unique_three_hop_path(graph, of("path").select("qid", a.alias("start"), b.alias("target")))
    path = path.select("qid", F.explode(F.array("left", "right")).alias("node_id"))
    similarity = same_category_distance_two(graph, of("similarity").select("qid", a.alias("seed")), categories)
    return direct.unionByName(comparison).unionByName(path).unionByName(similarity)


def label_faults(graph: Graph, questions: DataFrame, categories: DataFrame, *, ordered_paths: bool = False) -> DataFrame:
    """(qid, fault) of questions whose labels are empty, hold a seed or no node, or differ from the topology's.

    questions: (qid, question_type, seeds, relevant). ordered_paths also holds a path's labels to their order.
    """
    labels = questions.select("qid", "seeds", F.explode(F.array_distinct("relevant")).alias("node_id"))
    empty = questions.where(F.size("relevant") <= 0).select("qid", F.lit("empty").alias("fault"))
    seed = labels.where(F.array_contains("seeds", F.col("node_id"))).select("qid", F.lit("seed").alias("fault"))
    unknown = labels.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("qid", F.lit("unknown").alias("fault"))
    wanted, given = expected_labels(graph, questions, categories).distinct(), labels.select("qid", "node_id")
    topology = wanted.exceptAll(given).union(given.exceptAll(wanted)).select("qid", F.lit("topology").alias("fault"))
    found = empty.union(seed).union(unknown).union(topology)
    if ordered_paths:
        own = questions.where("question_type = 'path'")
        path = unique_three_hop_path(graph, own.select("qid", F.col("seeds")[0].alias("start"), F.get("seeds", F.lit(1)).alias("target")))
        wrong = own.join(path, "qid").where(F.col("relevant") != F.array("left", "right")).select("qid", F.lit("order").alias("fault"))
        found = found.union(wrong)
    return found.distinct()


def path_candidates(graph: Graph, starts: DataFrame, *, limit: int | None = 250, seed: int = 0) -> DataFrame:
    """(qid, node_id): up to `limit` distinct ends of walks of three edges, in an order that a hash decides; all ends for None.

    The limit is the operator: a bounded sample of targets for each start, the same under any partitioning. It holds at every
    hop, so that hubs don't multiply: a node goes on to the first `limit` of its neighbours, a start by its first `limit` walks
    of two edges, each in the order of digests.
    """
    digest = lambda *columns: F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)

    def first(df: DataFrame, by: str, *columns: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(digest(by, *columns), *columns)
        return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")

    adj = graph.adjacency if limit is None else first(graph.adjacency, "src", "dst")
    one = starts.join(adj, F.col("start") == F.col("src")).select("qid", "start", F.col("dst").alias("left"))
    two = one.join(adj, F.col("left") == F.col("src")).where("dst <> start").select("qid", "start", "left", F.col("dst").alias("right"))
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    if limit is None:
        # few walks of two edges make very many of three, so they are dealt to all tasks first
        dealt = two.repartition(parts, "qid")
        return dealt.join(adj, F.col("right") == F.col("src")).where("dst <> start and dst <> left").select("qid", F.col("dst").alias("node_id")).distinct()
    # a node's ends go together, at most limit of them for each of at most limit walks, and are told apart where their start's meet
    near = adj.groupBy(F.col("src").alias("right")).agg(F.collect_list("dst").alias("ends"))
    three = first(two, "qid", "left", "right").join(near, "right").select("qid", F.filter("ends", lambda x: (x != F.col("start")) & (x != F.col("left"))).alias("ends"))
    met = three.repartition(parts, "qid").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))
    return first(met.select("qid", F.explode("ends").alias("node_id")), "qid", "node_id")
