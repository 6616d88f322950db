"""Graph propagation for many questions at once: frontier joins, one shuffle a hop.

Seeds are (qid, node_id). A hop joins the frontier with the graph by source and sums by (question, target), so partial
sums leave every task before the shuffle; adaptive execution broadcasts a small frontier and splits hubs. Scores are
ranked after rounding to 12 digits, as sums in another order differ beyond that.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.schema import MAX_DEPTH, PAIRS, BiasConfig, Parameters, positive
from wayfare.sources.cut import kept, written
from wayfare.sources.graph import Graph, ranked_by

DIGITS = 12
#: Rows of a frontier up to which its last hop is made whole at once.
LIGHT = 2_000_000
#: The depth from which on a last hop may be bounded; shorter walks are made whole.
LONG = 3
#: The hop up to which a frontier's parts are hashed: few of the nodes for each question, or one time all of them.
HASHED = 2
#: Masses in a row of the frontier of a long walk: so many questions walk together, a column each.
WIDTH = 16


def valid_seeds(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(qid, node_id, mass): distinct seeds that are nodes, sharing a mass of one."""
    own = seeds.select("qid", "node_id").distinct().join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return own.withColumn("mass", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid")))


def given(graph: Graph, frontier: DataFrame, own: list[str], hashed: bool, masses: tuple[str, ...] = ("mass",)) -> DataFrame:
    """(qid, node_id, own, masses) a hop further, not summed yet: what a node gives for a unit of weight meets its arcs.

    hashed: the frontier's parts are hashed and the arcs stream past, unsorted; else both are sorted, and may spill.
    """
    each = _side(frontier, hashed).join(graph.totals, F.col("node_id") == F.col("id")).select("qid", "node_id", *own, *[(F.col(m) / F.col("total")).alias(m) for m in masses])
    moved = _side(each, hashed).join(graph.arcs, F.col("node_id") == F.col("src"))
    return moved.select("qid", F.col("dst").alias("node_id"), *own, *[(F.col(m) * F.col("weight")).alias(m) for m in masses])


def _side(df: DataFrame, hashed: bool) -> DataFrame:
    return df.hint("shuffle_hash" if hashed else "merge")


def _sums(masses: tuple[str, ...]) -> list[Column]:
    return [F.sum(m).alias(m) for m in masses]


def together(starts: DataFrame, own: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """(question, qid, slot) and (qid, node_id, own, mass, slot) of starts (qid, node_id, own, mass): up to `width` questions of equal own columns become one,
    in which each has a slot. A hop of many questions over the same nodes is then a row an arc, not a row an arc and question.
    """
    if width == 1:
        return starts.select(F.col("qid").alias("question"), "qid", F.lit(0).alias("slot")).distinct(), starts.withColumn("slot", F.lit(0))
    n = F.col("_n") - 1
    numbers = ranked_by(starts.select("qid", *own).distinct().withColumn("_key", F.struct(*own, "qid")), "_key", "_n")
    block = F.concat_ws("|", *own, F.floor(n / width))
    names = written(numbers.select(F.col("qid").alias("question"), block.alias("qid"), (n % width).cast("int").alias("slot")))
    found = starts.withColumnRenamed("qid", "question").join(names, "question").drop("question")
    return names, found


def frontiers(graph: Graph, seeds: DataFrame, depth: int, limits: DataFrame | None = None) -> list[DataFrame]:
    """(qid, node_id, mass, further columns of limits) of hops 0 to depth, each written, so that none is walked anew for the next.

    limits: (qid, last) of questions that go less far, which leave the frontier there; others have no rows.
    """
    own = [] if limits is None else [c for c in limits.columns if c != "qid"]
    frontier = valid_seeds(graph, seeds) if limits is None else valid_seeds(graph, seeds).join(limits, "qid")
    found = [frontier.select("qid", "node_id", *own, "mass")]
    for hop in range(1, depth + 1):
        found[-1] = written(found[-1])
        going = found[-1] if limits is None else found[-1].where(F.col("last") >= hop)
        found.append(given(graph, going, own, hop <= HASHED).groupBy("qid", "node_id", *own).agg(F.sum("mass").alias("mass")))
    return found


def hop_masses(graph: Graph, seeds: DataFrame, depth: int, limits: DataFrame | None = None) -> DataFrame:
    """(qid, hop, node_id, mass) for hops 0 to depth; every depth, decay and top_k is a weighting of these.

    limits: (qid, depth) of questions that go less far; others have no rows.
    """
    found = frontiers(graph, seeds, depth, None if limits is None else limits.select("qid", F.col("depth").alias("last")))
    return reduce(DataFrame.unionAll, [rows.select("qid", F.lit(hop).alias("hop"), "node_id", "mass") for hop, rows in enumerate(found)])


def walk_scores(graph: Graph, seeds: DataFrame, depth: int, parameters: Parameters | DataFrame) -> DataFrame:
    """(qid, node_id, score) of walks that one decay weighs each: the last hop is summed once, together with those before it."""
    limits, decay = None, F.lit(parameters.decay) if isinstance(parameters, Parameters) else F.col("decay")
    if not isinstance(parameters, Parameters):
        limits = parameters.select("qid", F.col("depth").alias("last"), "decay")
    own = [] if limits is None else ["last", "decay"]
    found = frontiers(graph, seeds, max(depth - 1, 0), limits)
    if depth:
        found[-1] = written(found[-1])
        going = found[-1] if limits is None else found[-1].where(F.col("last") >= depth)
        found.append(given(graph, going, own, depth <= HASHED))
    weighed = [rows.select("qid", "node_id", (F.pow(decay, F.lit(hop)) * F.col("mass")).alias("score")) for hop, rows in enumerate(found)]
    return reduce(DataFrame.unionAll, weighed).groupBy("qid", "node_id").agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame, group: list[str], top_k: int | Column, *ties: Column) -> DataFrame:
    """Adds rank, 1 to top_k, by falling rounded score and the ties."""
    order = Window.partitionBy(*group).orderBy(F.round("score", DIGITS).desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def leading(scores: DataFrame, group: list[str], top_k: int) -> DataFrame:
    """The rows of scores (group, node_id, score) that can be among the top_k of their group, all ties kept: few, found without a sort or a shuffle of all.

    Nodes are dealt into parts by hash. The top_k-th of the parts' best scores is reached by top_k nodes at least, so what is below it is not among
    the best. scores is read twice, so it should stand on a written table.
    """
    value = F.round("score", DIGITS)
    best = scores.groupBy(*group, F.pmod(F.xxhash64("node_id"), F.lit(8 * top_k)).alias("part")).agg(F.max(value).alias("best"))
    floors = written(best.groupBy(*group).agg(F.get(F.sort_array(F.collect_list("best"), False), F.lit(top_k - 1)).alias("floor")))
    return scores.join(floors, group).where(F.col("floor").isNull() | (value >= F.col("floor"))).drop("floor")


def weighted_best(graph: Graph, seeds: DataFrame, depth: int, weightings: DataFrame, top_k: int, limits: DataFrame | None = None) -> DataFrame:
    """(qid, depth, decay, node_id, score) of each weighting (qid, depth, decay) of one walk: all nodes that can be among its top_k, with whole scores.

    limits: (qid, depth) of questions that go less far.
    """
    starts, own = valid_seeds(graph, seeds), []
    if limits is not None:
        starts, own = starts.join(limits.select("qid", F.col("depth").alias("last")), "qid"), ["last"]
    width = WIDTH if depth >= LONG else 1
    names, starts = together(starts, own, width)
    masses = tuple(f"m{i}" for i in range(width))
    found = [starts.groupBy("qid", "node_id", *own).agg(*[F.sum(F.when(F.col("slot") == i, F.col("mass"))).alias(m) for i, m in enumerate(masses)])]
    for hop in range(1, depth + 1):
        found[-1] = written(found[-1])
        moved = given(graph, found[-1].where(F.col("last") >= hop) if own else found[-1], own, hop <= HASHED, masses)
        # rows of many masses are summed by themselves first, as a node's hops side by side are much wider
        found.append(moved if hop == depth and width == 1 else moved.groupBy("qid", "node_id", *own).agg(*_sums(masses)))
    rows = reduce(DataFrame.unionAll, [df.select("qid", F.lit(hop).alias("hop"), "node_id", *masses) for hop, df in enumerate(found)])
    hops = lambda m: F.array(*[F.sum(F.when(F.col("hop") == h, F.col(m))) for h in range(depth + 1)])
    wide = written(rows.groupBy("qid", "node_id").agg(*[hops(m).alias(m) for m in masses]))
    each = wide.select("qid", "node_id", F.inline(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(m).alias("m")) for i, m in enumerate(masses)])))
    of = lambda h: F.col("m")[h]
    each = each.withColumn("nearest", F.coalesce(*[F.when(of(h).isNotNull(), h) for h in range(depth + 1)])).where("nearest is not null")
    cells = weightings.select(F.col("qid").alias("question"), "depth", "decay").join(names, "question")
    cells = written(cells.select("qid", "slot", "depth", "decay", "question"))
    weighed = reduce(lambda x, y: x + y, [F.when(F.col("depth") >= h, F.pow("decay", F.lit(h)) * F.coalesce(of(h), F.lit(0.0))).otherwise(0.0) for h in range(depth + 1)])
    scored = each.join(cells, ["qid", "slot"]).where("nearest <= depth").select(F.col("question").alias("qid"), "depth", "decay", "node_id", weighed.alias("score"))
    return leading(scored, ["qid", "depth", "decay"], top_k)


def propagate(graph: Graph, seeds: DataFrame, parameters: Parameters | DataFrame, *, max_depth: int | None = None, light: int = LIGHT) -> DataFrame:
    """(qid, rank, node_id, score): sums of decay ** hop times the mass of a weighted random walk's hop.

    parameters: one for all, or a table (qid, depth, decay, top_k), in which each question walks its own depth; max_depth is
    its largest, looked up where it is not given. With a column `condition` a question has several rows, whose scores are
    weightings of one walk, and ranks have the column too. Reached nodes of score zero are kept. Mass on a node without neighbours
    vanishes. light: see deepest_scores.
    """
    if isinstance(parameters, Parameters):
        parameters.validate()
        depth, decay, top_k = parameters.depth, F.lit(parameters.decay), F.lit(parameters.top_k)
        if depth >= LONG and parameters.decay:
            before = kept(hop_masses(graph, seeds, depth - 1))
            deep = before.select("*", decay.alias("decay"), top_k.alias("top_k"))
            scored = deepest_scores(graph, deep, depth, light)
        else:
            scored = walk_scores(graph, seeds, depth, parameters)
        return ranked(scored, ["qid"], parameters.top_k, F.col("node_id").asc()).select("qid", "rank", "node_id", "score")
    by = ["qid", "condition"] if "condition" in parameters.columns else ["qid"]
    parameters = written(parameters.select(*by, "depth", "decay", "top_k"))
    most = parameters.agg(F.max("depth"), F.max("top_k")).first()
    max_depth, longest = most[0] or 0 if max_depth is None else max_depth, most[1] or 0
    asked, walks = same_walks(seeds, parameters, by)
    starts = seeds.join(walks.select("qid").distinct(), "qid", "left_semi")
    # a walk of several conditions has no single floor, and without a decay no score beyond the seeds
    if "condition" in by:
        limits = walks.groupBy("qid").agg(F.max("depth").alias("depth"))
        scored = weighted_best(graph, starts, max_depth, walks, max(longest, 1), limits)
    elif max_depth < LONG or not walks.where("decay = 0").limit(1).isEmpty():
        scored = walk_scores(graph, starts, max_depth, walks)
    else:
        before = kept(hop_masses(graph, starts, max_depth - 1, walks)).join(walks.withColumn("top_k", F.lit(longest)), "qid")
        short = before.where((F.col("depth") < max_depth) & (F.col("hop") <= F.col("depth"))).groupBy("qid", "node_id").agg(F.sum(F.pow("decay", "hop") * F.col("mass")).alias("score"))
        scored = short.unionByName(deepest_scores(graph, before.where(F.col("depth") == max_depth).drop("depth"), max_depth, light))
    # ranked to the longest list asked for, a constant, so that tasks keep few rows before they meet
    on = ["qid", "depth", "decay"] if "condition" in by else ["qid"]
    best = written(ranked(scored, on, longest, F.col("node_id").asc()))
    found = asked.join(best.withColumnRenamed("qid", "walk"), [c if c != "qid" else "walk" for c in on]).where(F.col("rank") <= F.col("top_k"))
    return found.select(*by, "rank", "node_id", "score")


def same_walks(seeds: DataFrame, parameters: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, depth, decay, top_k, walk) and (qid, depth, decay): questions of the same seeds walk once, as the first of them.

    Without conditions a walk has one depth and decay; with them it has several, each a weighting of its hops.
    """
    sets = seeds.groupBy("qid").agg(F.sort_array(F.collect_set("node_id")).alias("nodes"))
    alike = Window.partitionBy("nodes") if "condition" in by else Window.partitionBy("nodes", "depth", "decay")
    asked = written(parameters.join(sets, "qid").withColumn("walk", F.min("qid").over(alike)).drop("nodes"))
    return asked, written(asked.select(F.col("walk").alias("qid"), "depth", "decay").distinct())


def deepest_scores(graph: Graph, before: DataFrame, depth: int, light: int = LIGHT, most: int = 1000) -> DataFrame:
    """(qid, node_id, score): of each question at least its top_k best nodes with their whole scores; others may have less than theirs.

    before: (qid, hop, node_id, mass, decay, top_k) of the hops before `depth`. A frontier of at most `light` rows makes its last hop
    whole. Of a larger one the `most` nodes that give most for a unit of weight go first; what the others can still add to a node is
    at most the next one's gift times the node's weight. Nodes that stay under the top_k-th best score even with that get no more:
    so those of large weight are reached by the edges into them, and the others near the floor look up their own neighbours.
    """
    last = before.where(F.col("hop") == depth - 1)
    score = F.sum(F.pow("decay", "hop") * F.col("mass")).alias("score")
    known = before.groupBy("qid", "node_id").agg(score)
    summed = lambda *parts: reduce(DataFrame.unionByName, parts).groupBy("qid", "node_id").agg(F.sum("score").alias("score"))
    if last.limit(light + 1).count() <= light:
        moved = given(graph, last.select("qid", "node_id", (F.pow("decay", F.lit(depth)) * F.col("mass")).alias("mass")), [], depth <= HASHED)
        return summed(known, moved.withColumnRenamed("mass", "score"))
    weight = graph.totals.withColumnRenamed("id", "node_id")
    gift = (F.pow("decay", F.lit(depth)) * F.col("mass") / F.col("total")).alias("gift")
    gifts = kept(last.join(weight, "node_id").select("qid", "node_id", gift))
    top = kept(gifts.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gift")))).where(F.col("n") <= most))
    rest = gifts.join(top.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
    one = (F.col("gift") * F.col("weight")).alias("score")
    first = top.join(graph.arcs, F.col("node_id") == F.col("src")).select("qid", F.col("dst").alias("node_id"), one)
    lower = kept(summed(known, first))
    asked = before.select("qid", "top_k").distinct()
    longest = asked.agg(F.max("top_k")).first()[0]
    nth = lower.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("n") <= longest)
    floor = nth.join(asked, "qid").where(F.col("n") == F.col("top_k")).select("qid", F.col("score").alias("floor"))
    # a little lower than rounding and the order of sums can hide; without a floor all nodes are reached
    limits = top.where(F.col("n") == most).select("qid", (F.col("gift") * (1 + 1e-9)).alias("most")).join(floor, "qid", "left")
    limits = kept(limits.select("qid", "most", F.coalesce(F.col("floor") - 10.0 * 10.0**-DIGITS, F.lit(0.0)).alias("floor")))
    heaviest = limits.agg(F.min(F.col("floor") / F.col("most"))).first()[0]
    if heaviest is None:
        return lower
    reachable = F.col("total") * F.col("most") >= F.col("floor")
    into = weight.where(F.col("total") >= heaviest).withColumnRenamed("node_id", "src").join(graph.arcs, "src")
    into = into.select(F.col("src").alias("end"), "total", F.col("dst").alias("node_id"), "weight")
    heavy = rest.join(limits, "qid").join(into, "node_id").where(reachable).select("qid", F.col("end").alias("node_id"), one)
    near = lower.join(limits, "qid").join(weight, "node_id").where(~reachable & (F.col("score") + F.col("total") * F.col("most") >= F.col("floor")))
    looked = near.select("qid", F.col("node_id").alias("end")).join(graph.arcs, F.col("end") == F.col("src")).select("qid", "end", F.col("dst").alias("node_id"), "weight")
    light_ones = looked.join(rest, ["qid", "node_id"]).select("qid", F.col("end").alias("node_id"), one)
    return summed(lower, heavy, light_ones)


def seed_only(graph: Graph, seeds: DataFrame) -> DataFrame:
    return propagate(graph, seeds, Parameters(0, 0.0, 10))


def _raised(base: Column, exponent: float) -> Column | None:
    """base ** exponent, None for one."""
    return {0.0: None, 0.5: F.sqrt(base), 1.0: base}.get(exponent, F.pow(base, F.lit(exponent)))


def _over(mass: Column, base: str, exponent: float) -> Column:
    by = _raised(F.col(base), exponent)
    return mass if by is None else mass / by


def biased_scores(graph: Graph, seeds: DataFrame, pairs: dict[str, tuple[float, float]], parameters: Parameters | DataFrame, *, epsilon: float | Column | None = None, seed: int = 0, max_depth: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(qid, arm, node_id, score): a hop divides by source degree ** b and target degree ** a; weights (1 - decay) * decay ** i.

    All arms walk together: a row of the frontier holds the mass of each, so a hop is one join and one aggregation
    whatever their number. So do all questions, each to its own depth, where parameters is a table (qid, depth, decay, top_k); in long walks several
    are one row. A hop is written, the last one is summed once, with those before it, and the scores are written.
    epsilon turns on the sampled mode: a contribution under it is raised to it with the probability that keeps its mean, and
    dropped otherwise; the draw is a hash of question, arm, hop and edge, the same under any partitioning. It may depend on
    the question's depth, the column `last`. wanted: (qid, node_id) of the scores that are asked for, where that is not all; what others get in
    each hop is not summed up.
    """
    starts = valid_seeds(graph, seeds)
    if isinstance(parameters, Parameters):
        own, depth, decay, wrong = [], parameters.depth, F.lit(float(parameters.decay)), not 0 <= parameters.decay < 1
    else:
        own, decay, wrong = ["last", "decay"], F.col("decay"), not parameters.where("decay < 0 or decay >= 1").limit(1).isEmpty()
        depth = max_depth if max_depth is not None else parameters.agg(F.max("depth")).first()[0] or 0
        starts = starts.join(parameters.select("qid", F.col("depth").alias("last"), "decay"), "qid")
    if wrong:
        raise ValueError("these weights require a decay of at least 0 and less than 1")
    width = max(1, WIDTH // len(pairs)) if depth >= LONG else 1
    columns = list(product(range(width), pairs))
    masses = tuple(f"m{i}" for i in range(len(columns)))
    names, starts = together(starts, own, width)
    frontier = starts.groupBy("qid", "node_id", *own).agg(*[F.sum(F.when(F.col("slot") == slot, F.col("mass"))).alias(m) for m, (slot, _) in zip(masses, columns)])
    degrees = graph.degrees.select(F.col("id").alias("node_id"), F.col("degree").cast("double").alias("degree"))
    by = lambda end: [(m, pairs[arm][end]) for m, (_, arm) in zip(masses, columns)]
    if epsilon is None:  # what depends on the source alone is divided before the join, on the target after the sum
        found = [frontier.join(degrees, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(1.0)))]
    else:
        found = [frontier]
        own_names = F.array(F.col("qid")) if width == 1 else F.col("names")
        slots = written(names.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "question"))), lambda x: x["question"]).alias("names"))) if width > 1 else None
    for hop in range(1, depth + 1):
        found[-1] = written(found[-1])
        going = found[-1].where(F.col("last") >= hop) if own else found[-1]
        if epsilon is None:
            gifts = going.select("qid", "node_id", *own, *[_over(F.col(m), "degree", b).alias(m) for m, b in by(1)])
            moved = _side(gifts, hop <= HASHED).join(graph.adjacency, F.col("node_id") == F.col("src")).select("qid", F.col("dst").alias("node_id"), *own, *masses)
            if hop < depth:
                moved = moved.groupBy("qid", "node_id", *own).agg(*_sums(masses)).join(degrees, "node_id")
                moved = moved.select("qid", "node_id", "degree", *own, *[_over(F.col(m), "degree", a).alias(m) for m, a in by(0)])
        else:
            least = epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
            moved = _side(going, hop <= HASHED).join(graph.biased, F.col("node_id") == F.col("src"))
            moved = moved if slots is None else moved.join(slots, "qid")
            drawn = []
            for m, (slot, arm) in zip(masses, columns):
                gift = _over(_over(F.col(m), "src_degree", pairs[arm][1]), "dst_degree", pairs[arm][0])
                draw = F.pmod(F.xxhash64(F.get(own_names, F.lit(slot)), F.lit(arm), F.lit(hop), "src", "dst", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0
                drawn.append(F.when(gift >= least, gift).when(draw * least < gift, least).alias(m))
            moved = moved.select("qid", F.col("dst").alias("node_id"), *own, *drawn)
            moved = moved.where(F.coalesce(*masses).isNotNull())  # what is dropped for all goes no further
            moved = moved if hop == depth else moved.groupBy("qid", "node_id", *own).agg(*_sums(masses))
        found.append(moved)

    def weighed(hop: int, rows: DataFrame) -> DataFrame:
        share = (1 - decay) * F.pow(decay, F.lit(hop))
        # the whole sum is divided by the target's degrees, so hops that are divided already are multiplied
        back = lambda m, a: F.col(m) if epsilon is not None or (hop and hop == depth) or not a else F.col(m) * _raised(F.col("degree"), a)
        return rows.select("qid", "node_id", *[(share * back(m, a)).alias(m) for m, a in by(0)])

    if wanted is not None:
        # the asked (qid, node_id) by the names under which questions walk
        asked = wanted.join(names.select(F.col("question"), F.col("qid").alias("walk")), F.col("qid") == F.col("question")).select(F.col("walk").alias("qid"), "node_id").distinct()
        asked = written(asked)
        found = [rows.join(asked, ["qid", "node_id"], "left_semi") for rows in found]
    total = reduce(DataFrame.unionAll, [weighed(hop, rows) for hop, rows in enumerate(found)]).groupBy("qid", "node_id").agg(*_sums(masses))
    if epsilon is None:
        total = total.join(degrees, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(1.0)))
        total = total.select("qid", "node_id", *[_over(F.col(m), "degree", a).alias(m) for m, a in by(0)])
    each = F.array(*[F.struct(F.lit(slot).alias("slot"), F.lit(arm).alias("arm"), F.col(m).alias("score")) for m, (slot, arm) in zip(masses, columns)])
    scored = written(total).select("qid", "node_id", F.inline(each)).where((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") < float("inf")))
    if width > 1:
        scored = scored.join(names, ["qid", "slot"]).drop("qid").withColumnRenamed("question", "qid")
    if wanted is not None:
        scored = scored.join(wanted.select("qid", "node_id").distinct(), ["qid", "node_id"], "left_semi")
    return scored.select("qid", "arm", "node_id", "score")


def propagate_biased(graph: Graph, seeds: DataFrame, pairs: dict[str, tuple[float, float]] = PAIRS, parameters: Parameters | DataFrame = Parameters(2, 0.3, 10), *, query_type: str = "N", check: bool = False, epsilon: float | None = None, backend: BiasConfig | None = None, seed: int = 0) -> DataFrame:
    """(qid, arm, rank, node_id, score) for every (a, b) pair; ties go to the node that was loaded first.

    parameters: one for all, or a table (qid, depth, decay, top_k). check: reject weighted graphs, and for query type S isolated
    nodes, before anything runs. backend: query type S samples under its error bound, for each depth its own.
    """
    if isinstance(parameters, Parameters):
        parameters.validate()
    if check:
        graph.require_unit_weights()
        if query_type == "S":
            graph.require_no_isolated()
    if backend is not None and backend.validate().query_type == "S":
        nodes = graph.nodes.count() if backend.delta is None else 0
        if isinstance(parameters, Parameters):
            epsilon = backend.threshold(nodes, parameters.depth)
        else:
            epsilon = F.coalesce(*[F.when(F.col("last") == d, F.lit(backend.threshold(nodes, d))) for d in range(MAX_DEPTH + 1)])
    scored = biased_scores(graph, seeds, pairs, parameters, epsilon=epsilon, seed=seed)
    top_k: int | Column = parameters.top_k if isinstance(parameters, Parameters) else F.col("top_k")
    longest = parameters.top_k if isinstance(parameters, Parameters) else parameters.agg(F.max("top_k")).first()[0] or 1
    # few are left, so only these look up their places
    best = written(leading(scored, ["qid", "arm"], longest))
    placed = best.join(graph.nodes.select(F.col("id").alias("node_id"), "pos"), "node_id")
    if not isinstance(parameters, Parameters):
        placed = placed.join(parameters.select("qid", "top_k"), "qid")
    return ranked(placed, ["qid", "arm"], top_k, F.col("pos").asc()).select("qid", "arm", "rank", "node_id", "score")


def direct_neighbours(graph: Graph, seeds: DataFrame, *, top_k: int = 10, check: bool = False) -> DataFrame:
    """(qid, rank, node_id, score): neighbours of the seeds that are no seeds, by the number of distinct seeds adjacent."""
    positive("top_k", top_k)
    if check:
        graph.require_unit_weights()
    own = seeds.select("qid", "node_id").distinct()
    near = own.join(graph.adjacency, F.col("node_id") == F.col("src")).select("qid", F.col("dst").alias("node_id"))
    outside = near.join(own, ["qid", "node_id"], "left_anti")
    scored = outside.groupBy("qid", "node_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return ranked(scored, ["qid"], top_k, F.col("node_id").asc()).select("qid", "rank", "node_id", "score")
