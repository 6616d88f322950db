"""Registered queries over the driver's tables, each through its operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import text as tx
from wayfare.operators import context as cx
from wayfare.operators import matching as mt
from wayfare.operators import metrics as me
from wayfare.operators import propagation as pr
from wayfare.operators import selection as se
from wayfare.operators import topology as tp
from wayfare.schema import PAIRS, STUDY, Parameters
from wayfare.sources.cut import written
from wayfare.sources.graph import Graph, trade_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_KEPT: dict[tuple[str, str], Graph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The trade graph of a folder, its derived tables persisted until another folder's are asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        for (application, _), graph in _KEPT.items():
            if application == key[0]:
                graph.release()
        _KEPT.clear()
        _KEPT[key] = trade_graph(spark, sf_dir).keep("arcs", "totals", "adjacency", "biased", "titles", "mention_index", "postings", "gram_counts")
    return _KEPT[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every nation, its seeds the nation and its region."""
    n = read(spark, sf_dir, "nation")
    qid = F.concat(F.lit("q"), F.col("n_nationkey").cast("string"))
    one = n.select(qid.alias("qid"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return one.unionAll(n.select(qid.alias("qid"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("node_id")))


def nation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each type, and one of none, for every nation."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = list(tx.TEMPLATES["pages"].items()) + [("none", "Why does {a} trade with {b}?"), ("none2", "{a} vs {b}")]
    out = None
    for name, form in forms:
        own = n.select(F.concat(F.lit(name), F.col("n_nationkey").cast("string")).alias("qid"), tx.templated(form, F.col("n_name"), F.col("r_name")).alias("question"))
        out = own if out is None else out.unionAll(own)
    return out


NODES_SQL = """
nodes as (
  select 'r' || r_regionkey as id, r_name as title, 'region' as description, r_regionkey as pos from region
  union all select 'n' || n_nationkey, n_name, 'nation', 1000000000000 + n_nationkey from nation
  union all select 'c' || c_custkey, c_name, 'customer', 2000000000000 + c_custkey from customer
  union all select 's' || s_suppkey, s_name, 'supplier', 3000000000000 + s_suppkey from supplier
  union all select 'p' || p_partkey, p_name, 'part', 4000000000000 + p_partkey from part)"""
EDGES_SQL = """
edges as (
  select 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'in' as description, cast(n_nationkey as bigint) as pos from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, 'of', 1000000000000000 + c_custkey from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, 'of', 2000000000000000 + s_suppkey from supplier
  union all select 'p' || l_partkey, 's' || l_suppkey, 'from', 3000000000000000 + l_orderkey * 1000 + l_linenumber from lineitem
  union all select 'c' || o_custkey, 'p' || l_partkey, 'bought', 4000000000000000 + l_orderkey * 1000 + l_linenumber from lineitem join orders on l_orderkey = o_orderkey)"""
ADJ_SQL = "adj as (select distinct least(source, target) as src, greatest(source, target) as dst from edges where source <> target union select distinct greatest(source, target), least(source, target) from edges where source <> target)"
TR_SQL = """
tw as (select src, dst, cast(count(*) as double) as weight from (select source as src, target as dst from edges union all select target, source from edges) where src <> dst group by src, dst),
tr as (select src, dst, weight, weight / sum(weight) over (partition by src) as share from tw)"""
SEEDS_SQL = """
seeds as (select 'q' || n_nationkey as qid, 'n' || n_nationkey as node_id from nation union all select 'q' || n_nationkey, 'r' || n_regionkey from nation),
h0 as (select qid, node_id, cast(1 as double) / count(*) over (partition by qid) as mass from seeds)"""
G = f"with {NODES_SQL}, {EDGES_SQL}, {ADJ_SQL}"


def propagation_sql(depth: int, decay: float, top_k: int) -> str:
    """CTEs that end in ranks (qid, rank, node_id, score)."""
    hops = "".join(f", h{i} as (select qid, dst as node_id, sum(mass * share) as mass from h{i - 1} join tr on src = node_id group by qid, dst)" for i in range(1, depth + 1))
    total = " union all ".join(f"select qid, node_id, mass * pow(cast({decay} as double), {i}) as s from h{i}" for i in range(depth + 1))
    return f"""with {NODES_SQL}, {EDGES_SQL}, {TR_SQL}, {SEEDS_SQL}{hops},
scored as (select qid, node_id, sum(s) as score from ({total}) group by qid, node_id),
ranks as (select qid, node_id, score, cast(row_number() over (partition by qid order by round(score, 12) desc, node_id) as integer) as rank from scored qualify rank <= {top_k})"""


RANKED = "select qid, rank, node_id, round(score, 9) as score from ranks"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


# ---- the graph ---------------------------------------------------------------------------------------------------


@_query(f"{G} select src, dst from adj")
def adjacency(spark, sf_dir):
    return graph_of(spark, sf_dir).adjacency


@_query(f"with {NODES_SQL}, {EDGES_SQL}, {TR_SQL} select src, dst, weight, round(share, 9) as share from tr")
def transition_weights(spark, sf_dir):
    return graph_of(spark, sf_dir).transition.withColumn("share", F.round("share", 9))


@_query(f"{G} select src as id, count(*) as degree from adj group by src")
def degrees(spark, sf_dir):
    return graph_of(spark, sf_dir).degrees


@_query(f"{G} select id from nodes where id not in (select src from adj)")
def isolated_nodes(spark, sf_dir):
    return graph_of(spark, sf_dir).isolated()


@_query("select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey")
def canonical_edges(spark, sf_dir):
    return tp.canonical_edges(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@_query(f"{G} select distinct target as id from edges where target not in (select id from nodes where description <> 'nation') union select distinct source from edges where source not in (select id from nodes where description <> 'nation')")
def unknown_endpoints(spark, sf_dir):
    graph = trade_graph(spark, sf_dir)
    return Graph(graph.nodes.where("description <> 'nation'"), graph.edges).unknown_endpoints()


TITLES_SQL = "titles as (select lower(trim(title)) as norm, arg_max(id, pos) as node_id, arg_min(title, pos) as title from nodes group by all)".replace("group by all", "group by 1")


@_query(f"{G}, {TITLES_SQL} select norm, node_id, title from titles")
def title_index(spark, sf_dir):
    return graph_of(spark, sf_dir).titles


@_query("""with d as (select l_partkey as id, count(distinct l_suppkey) as degree from lineitem group by 1)
select p_partkey as id, case when row_number() over (partition by lower(p_name) order by coalesce(degree, 0) desc, p_partkey) = 1 then p_name else p_name || ' [page ' || p_partkey || ']' end as title
from part left join d on id = p_partkey""")
def unique_titles(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("degree"))
    return tp.unique_titles(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), d)


@_query("""with e as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey)
select (select count(*) from part) as nodes, count(*) as raw_edge_rows, sum(case when l_partkey = l_suppkey then 1 else 0 end)::bigint as self_loops, (select count(*) from e) as edges,
(select count(*) from part where p_partkey not in (select a from e union select b from e)) as isolated,
(count(*) - sum(case when l_partkey = l_suppkey then 1 else 0 end) - (select count(*) from e))::bigint as duplicates from lineitem""")
def graph_summary(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"))
    return me.graph_summary(nodes, read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "category")[0]


# ---- propagation -------------------------------------------------------------------------------------------------


def _propagate(depth: int, decay: float, top_k: int = 10):
    def run(spark, sf_dir):
        return _rounded(pr.propagate(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir), Parameters(depth, decay, top_k)))

    return run


for _name, _args in {"propagate_depth_1": (1, 0.4), "propagate_depth_2": (2, 0.6), "propagate_depth_3": (3, 0.75), "propagate_study": (2, 0.3, 10), "propagate_decay_0": (1, 0.0, 20)}.items():
    QUERIES[_name] = _propagate(*_args)
    ORACLE_SQL[_name] = f"{propagation_sql(_args[0], _args[1], (*_args, 10)[2])} {RANKED}"


@_query(f"{propagation_sql(0, 0.0, 10)} {RANKED}")
def seed_only(spark, sf_dir):
    return _rounded(pr.seed_only(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir)))


@_query(f"with {SEEDS_SQL} select qid, node_id, mass from h0")
def seed_mass(spark, sf_dir):
    return pr.valid_seeds(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir)).select("qid", "node_id", "mass")


def _arms_sql() -> str:
    arms = ", ".join(f"('{k}', cast({a} as double), cast({b} as double))" for k, (a, b) in PAIRS.items())
    return f"""{G}, {SEEDS_SQL}, arms(arm, a, b) as (values {arms}), deg as (select src as id, cast(count(*) as double) as d from adj group by src),
bi as (select src, dst, x.d as sd, y.d as dd from adj join deg x on x.id = src join deg y on y.id = dst),
a0 as (select qid, arm, a, b, node_id, mass from h0 cross join arms),
a1 as (select qid, arm, a, b, dst as node_id, sum(mass / (pow(sd, b) * pow(dd, a))) as mass from a0 join bi on src = node_id group by qid, arm, a, b, dst),
a2 as (select qid, arm, a, b, dst as node_id, sum(mass / (pow(sd, b) * pow(dd, a))) as mass from a1 join bi on src = node_id group by qid, arm, a, b, dst),
t as (select qid, arm, node_id, mass * 0.7 as s from a0 union all select qid, arm, node_id, mass * 0.7 * 0.3 from a1 union all select qid, arm, node_id, mass * 0.7 * 0.09 from a2),
scored as (select qid, arm, node_id, sum(cast(s as double)) as score from t group by qid, arm, node_id)
select qid, arm, cast(row_number() over (partition by qid, arm order by round(score, 12) desc, pos) as integer) as rank, node_id, round(score, 11) as score
from scored join nodes on id = node_id qualify rank <= 10"""


@_query(_arms_sql())
def propagate_arms(spark, sf_dir):
    return pr.propagate_biased(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir), PAIRS, STUDY).withColumn("score", F.round("score", 11))


@_query(f"""{G}, {SEEDS_SQL},
near as (select qid, dst as node_id, cast(count(*) as double) as score from seeds join adj on src = node_id where (qid, dst) not in (select (qid, node_id) from seeds) group by qid, dst)
select qid, cast(row_number() over (partition by qid order by score desc, node_id) as integer) as rank, node_id, score from near qualify rank <= 10""")
def direct_neighbours(spark, sf_dir):
    return pr.direct_neighbours(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir))


# ---- topology ----------------------------------------------------------------------------------------------------


def _geography(spark, sf_dir) -> Graph:
    graph = trade_graph(spark, sf_dir)
    return Graph(graph.nodes, graph.edges.where("description in ('in', 'of')"))


GEO = f"with {NODES_SQL}, {EDGES_SQL.replace('edges as', 'all_edges as')}, edges as (select * from all_edges where description in ('in', 'of')), {ADJ_SQL}"


@_query("""with sa as materialized (select distinct l_suppkey as k, 'p' || l_partkey as dst from lineitem union all select s_suppkey, 'n' || s_nationkey from supplier)
select 's' || x.k || '-s' || y.k as qid, x.dst as node_id from sa x join sa y on y.k = x.k + 1 and y.dst = x.dst where x.k in (select s_suppkey from supplier)""")
def common_neighbours(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return tp.common_neighbours(graph_of(spark, sf_dir), s.select(F.concat("a", F.lit("-"), "b").alias("qid"), "a", "b"))


def _regions(spark, sf_dir) -> DataFrame:
    node = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    return read(spark, sf_dir, "region").select(node.alias("qid"), node.alias("seed"))


@_query(f"""{G}, q as (select 'r' || r_regionkey as seed from region)
select distinct seed as qid, y.dst as node_id from q join adj x on x.src = seed join adj y on y.src = x.dst where y.dst <> seed and (seed, y.dst) not in (select (src, dst) from adj)""")
def distance_two(spark, sf_dir):
    return tp.distance_two(graph_of(spark, sf_dir), _regions(spark, sf_dir))


CUSTOMERS_SQL = "cat as (select 'c' || c_custkey as id, c_mktsegment as category from customer)"


@_query(f"""{GEO}, {CUSTOMERS_SQL}
select distinct a.id as qid, y.dst as node_id from cat a join adj x on x.src = a.id join adj y on y.src = x.dst join cat b on b.id = y.dst and b.category = a.category
where y.dst <> a.id and (a.id, y.dst) not in (select (src, dst) from adj)""")
def same_category_distance_two(spark, sf_dir):
    node = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    own = read(spark, sf_dir, "customer").select(node.alias("id"), F.col("c_mktsegment").alias("category"))
    return tp.same_category_distance_two(_geography(spark, sf_dir), own.select(F.col("id").alias("qid"), F.col("id").alias("seed")), own)


@_query(f"""{GEO}, pairs as (select 'c' || c_custkey as start, 'n' || n_nationkey as target from customer cross join nation),
far as (select * from pairs where (start, target) not in (select (src, dst) from adj) and not exists (select 1 from adj x join adj y on x.dst = y.dst where x.src = start and y.src = target)),
paths as (select start, target, x.dst as l, z.src as r from far join adj x on x.src = start join adj y on y.src = x.dst join adj z on z.src = y.dst and z.dst = target where y.dst <> start and x.dst <> target)
select start || '-' || target as qid, min(l) as "left", min(r) as "right" from paths group by start, target having count(*) = 1""")
def unique_three_hop_path(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"))
    pairs = c.crossJoin(n).select(F.concat("start", F.lit("-"), "target").alias("qid"), "start", "target")
    return tp.unique_three_hop_path(_geography(spark, sf_dir), pairs)


# ---- text and matching -------------------------------------------------------------------------------------------

KEYWORDS_SQL = """
keywords as (select p_brand as qid, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as integer) as position,
  case when p_size < 26 then '  ' || upper(p_name) || ' ' else p_type || ' ' || p_name end as keyword from part)"""


def _keywords(spark, sf_dir) -> DataFrame:
    """For every brand, the names of its parts: some written otherwise, some with a word too many."""
    from pyspark.sql import Window

    p = read(spark, sf_dir, "part")
    text = F.when(F.col("p_size") < 26, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    return p.select(F.col("p_brand").alias("qid"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("position"), text.alias("keyword"))


@_query(f"""{G}, {TITLES_SQL}, {KEYWORDS_SQL}
select qid, node_id, min(position) as position from keywords join titles on norm = lower(trim(keyword)) group by qid, node_id""")
def exact_match(spark, sf_dir):
    return mt.exact_match(graph_of(spark, sf_dir), _keywords(spark, sf_dir))[0]


@_query(f"{G}, {TITLES_SQL}, {KEYWORDS_SQL} select qid, position, keyword from keywords where lower(trim(keyword)) not in (select norm from titles)")
def unmatched_keywords(spark, sf_dir):
    return mt.exact_match(graph_of(spark, sf_dir), _keywords(spark, sf_dir))[1]


def _misspelt(spark, sf_dir) -> DataFrame:
    """Every distinct part name and nation name with a letter too many or too few."""
    p = read(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    n = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    return p.union(n).select(F.explode(F.array(F.expr("substring(name, 1, length(name) - 1)"), F.concat("name", F.lit("x")))).alias("key")).distinct()


MISSPELT_SQL = """
names as (select distinct lower(p_name) as name from part union select lower(n_name) from nation),
keys as (select left(name, length(name) - 1) as key from names union select name || 'x' from names)"""
GRAMS_SQL = """
kg as (select distinct key, substring('  ' || key || '  ', i, 3) as gram from (select key, unnest(range(1, length(key) + 3)) as i from keys)),
tg as (select distinct norm, substring('  ' || norm || '  ', i, 3) as gram from (select norm, unnest(range(1, length(norm) + 3)) as i from titles)),
kn as (select key, count(*) as n from kg group by key), tn as (select norm, count(*) as n from tg group by norm),
sh as (select key, norm, count(*) as shared from kg join tg using (gram) group by key, norm),
cand as (select key, norm, cast(shared as double) / (kn.n + tn.n - shared) as jaccard, cast(row_number() over (partition by key order by cast(shared as double) / (kn.n + tn.n - shared) desc, norm) as integer) as place
  from sh join kn using (key) join tn using (norm) qualify place <= 50)"""


@_query(f"{G}, {TITLES_SQL}, {MISSPELT_SQL}, {GRAMS_SQL} select key, norm, round(jaccard, 9) as jaccard, place from cand")
def trigram_candidates(spark, sf_dir):
    return mt.trigram_candidates(graph_of(spark, sf_dir), _misspelt(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


SIMILAR = "case when {a} = {b} then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else 1.0 - cast(levenshtein({a}, {b}) as double) / greatest(length({a}), length({b})) end"


@_query(f"with n as (select distinct lower(p_name) as name from part) select x.name as a, y.name as b, round(cast({SIMILAR.format(a='x.name', b='y.name')} as double), 9) as similarity from n x cross join n y")
def edit_similarity(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    return n.select(F.col("name").alias("a")).crossJoin(F.broadcast(n.select(F.col("name").alias("b")))).select("a", "b", F.round(tx.edit_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


BEST_SQL = f"""
sims as (select key, norm, cast({SIMILAR.format(a='key', b='norm')} as double) as score from cand),
best as (select key, norm, score, lead(score) over (partition by key order by score desc, norm) as second_score, row_number() over (partition by key order by score desc, norm) as n from sims qualify n = 1)"""


@_query(f"""{G}, {TITLES_SQL}, {MISSPELT_SQL}, {GRAMS_SQL}, {BEST_SQL}
select key as qid, cast(0 as integer) as position, key as keyword, node_id, title as matched_title, round(case when x then 1.0 else score end, 9) as score, round(case when x then null else second_score end, 9) as second_score,
  case when x then 'exact' when score >= 0.85 and (second_score is null or score - second_score >= 0.1) then 'approximate' else 'unresolved' end as method,
  x or (score >= 0.85 and (second_score is null or score - second_score >= 0.1)) as accepted
from (select best.*, t.node_id, case when key in (select norm from titles) then (select title from nodes where id = t.node_id) else t.title end as title, key in (select norm from titles) as x from best join titles t using (norm))""")
def approximate_match(spark, sf_dir):
    keys = _misspelt(spark, sf_dir).select(F.col("key").alias("qid"), F.lit(0).alias("position"), F.col("key").alias("keyword"))
    return mt.approximate_match(graph_of(spark, sf_dir), keys).withColumns({c: F.round(c, 9) for c in ("score", "second_score")})


@_query()
def approximate_compound(spark, sf_dir):
    """Part names cut into their words, which only runs of keywords can match; compared with brute force in the tests."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qid"), F.posexplode(F.split(F.concat("p_name", F.lit(" of no title")), " ")).alias("position", "keyword"))
    return mt.approximate_match(graph_of(spark, sf_dir), p).withColumns({c: F.round(c, 9) for c in ("score", "second_score")})


QUESTIONS_SQL = """
nr as (select * from nation join region on n_regionkey = r_regionkey),
questions as (
  select 'direct' || n_nationkey as qid, 'Which pages directly neighbor ' || n_name as question from nr
  union all select 'comparison' || n_nationkey, 'Which pages are liked by both ' || n_name || ' and ' || r_name from nr
  union all select 'path' || n_nationkey, 'Which pages form the unique shortest path between ' || n_name || ' and ' || r_name from nr
  union all select 'similarity' || n_nationkey, 'Which pages similar to ' || n_name || ' share its category and are two hops away' from nr
  union all select 'none' || n_nationkey, 'Why does ' || n_name || ' trade with ' || r_name || '?' from nr
  union all select 'none2' || n_nationkey, n_name || ' vs ' || r_name from nr)"""


@_query(f"""with {QUESTIONS_SQL} select qid, case when q like '%directly neighbor%' then 'direct' when q like '%liked by both%' then 'comparison' when q like '%shortest path between%' then 'path'
 when q like '%similar to%' and q like '%two hops away%' then 'similarity' end as question_type from (select qid, lower(question) as q from questions)""")
def question_type(spark, sf_dir):
    return tx.with_folded(nation_questions(spark, sf_dir), "question", "norm").select("qid", tx.question_type(F.col("norm")).alias("question_type"))


def _any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in terms) + ")"


@_query(f"""with {QUESTIONS_SQL} select qid, cast(case when m then 3 when e then 2 when c then 2 else 1 end as integer) as depth, cast(case when m then 0.75 when e then 0.7 when c then 0.6 else 0.4 end as double) as decay, cast(10 as integer) as top_k
from (select qid, {_any('q', tx.MULTI_HOP)} as m, {_any('q', tx.EXPLANATORY)} as e, {_any("(' ' || q || ' ')", tx.COMPARISON)} as c from (select qid, lower(question) as q from questions))""")
def rule_parameters(spark, sf_dir):
    return tx.with_folded(nation_questions(spark, sf_dir), "question", "norm").select("qid", tx.rule_parameters(F.col("norm")).alias("p")).select("qid", "p.*")


@_query(f"""select keyword, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+')) as keyword from conversations)
where lower(keyword) not in ({', '.join(repr(x) for x in tx.STOP)}) group by keyword""")
def heuristic_keywords(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").select(F.explode(tx.heuristic_keywords(F.col("text"))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


MENTION_TEXT_SQL = "texts as (select cast(p_partkey as varchar) as qid, 'Is ' || p_name || ', of ' || upper(p_name) || ' made? See nation_' || (p_partkey % 25) || '.' as text from part)"


def _mention_texts(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.cast("string").alias("qid"), F.concat(F.lit("Is "), "p_name", F.lit(", of "), F.upper("p_name"), F.lit(" made? See nation_"), (key % 25).cast("string"), F.lit(".")).alias("text"))


MENTIONS_SQL = f"""{G}, {TITLES_SQL}, {MENTION_TEXT_SQL},
lens as (select distinct length(norm) as len from titles),
spans as (select qid, t, s, s + len - 1 as e from (select qid, lower(text) as t, unnest(range(1, length(text) + 1)) as s from texts) cross join lens where s + len - 1 <= length(t)),
mentions as (select qid, title, node_id, cast(s - 1 as integer) as "start", cast(e as integer) as "end" from spans join titles on norm = substring(t, s, e - s + 1)
  where (s = 1 or not regexp_matches(substring(t, s - 1, 1), '[a-z0-9_]')) and (e = length(t) or not regexp_matches(substring(t, e + 1, 1), '[a-z0-9_]')))"""


@_query(f"{MENTIONS_SQL} select * from mentions")
def title_mentions(spark, sf_dir):
    return mt.title_mentions(graph_of(spark, sf_dir), _mention_texts(spark, sf_dir))


def recursive(sql: str) -> str:
    return sql.replace("with", "with recursive", 1)


#: After a CTE mentions: the longer mention wins where two overlap, one after the other.
LOCAL_SQL = """
om as materialized (select *, row_number() over (partition by qid order by "start" - "end", "start", "end", title, node_id) as n from mentions),
rec as (
  select qid, cast(0 as bigint) as n, cast([] as struct(s integer, e integer, title varchar, node_id varchar)[]) as picked from (select distinct qid from om)
  union all select rec.qid, om.n, case when len(list_filter(rec.picked, lambda x: x.s < om."end" and x.e > om."start")) > 0 then rec.picked else list_append(rec.picked, struct_pack(s := om."start", e := om."end", title := om.title, node_id := om.node_id)) end
  from rec join om on om.qid = rec.qid and om.n = rec.n + 1),
chosen as (select qid, unnest(picked) as x from (select qid, arg_max(picked, n) as picked from rec group by qid)),
local as (select qid, cast(row_number() over (partition by qid order by x.s) - 1 as integer) as position, x.title as keyword, x.node_id as node_id from chosen)"""


@_query(recursive(f"{MENTIONS_SQL}, {LOCAL_SQL} select * from local"))
def local_keywords(spark, sf_dir):
    return mt.local_keywords(graph_of(spark, sf_dir), _mention_texts(spark, sf_dir))


@_query(recursive(f"{MENTIONS_SQL}, {LOCAL_SQL} select qid, node_id, min(position) as position from local group by qid, node_id"))
def mentioned_nodes(spark, sf_dir):
    return mt.mentioned_nodes(graph_of(spark, sf_dir), _mention_texts(spark, sf_dir))


@_query("select cast(o_orderkey as varchar) as id, cast(ascii(chr(('0x' || substring(sha256('90055:' || o_orderkey), 1, 2))::integer)) % 2 as integer) as first, substring(sha256('pair:90055:' || o_orderkey), 1, 12) as pair from orders")
def blind_order(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return read(spark, sf_dir, "orders").select(key.alias("id"), tx.blind_first(90055, key).alias("first"), tx.pair_id(90055, key).alias("pair"))


# ---- contexts ----------------------------------------------------------------------------------------------------

CONTEXT_SQL = propagation_sql(2, 0.3, 10)
REL_SQL = """rel as (select a.qid, e.source, e.target, e.description, e.pos from edges e join ranks a on a.node_id = e.source join ranks b on b.qid = a.qid and b.node_id = e.target)"""


def _study(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return graph, nation_seeds(spark, sf_dir), written(pr.propagate(graph, nation_seeds(spark, sf_dir), STUDY))


@_query(f"{CONTEXT_SQL}, {REL_SQL} select * from rel")
def context_relationships(spark, sf_dir):
    graph, _, ranked = _study(spark, sf_dir)
    return cx.selected_relationships(graph, ranked)


@_query(f"""{CONTEXT_SQL}, {REL_SQL},
ent as (select qid, string_agg('- ' || title || ' [score=' || printf('%.4f', score) || ']: ' || nodes.description, chr(10) order by rank) as t from ranks join nodes on id = node_id group by qid),
rl as (select qid, string_agg('- ' || a.title || ' -> ' || b.title || ': ' || rel.description, chr(10) order by rel.pos, a.title, b.title) as t from rel join nodes a on a.id = source join nodes b on b.id = target group by qid)
select ent.qid, 'Retrieved entities:' || chr(10) || ent.t || case when rl.t is null then '' else chr(10) || 'Retrieved relationships:' || chr(10) || rl.t end as context from ent left join rl on rl.qid = ent.qid""")
def context_text(spark, sf_dir):
    graph, seeds, ranked = _study(spark, sf_dir)
    return cx.context(graph, seeds, ranked)


def _capped_sql(cap: int) -> str:
    """Whole lines only: the entities that fit, then every relationship that still fits, in turn."""
    def lines(name: str, nodes: str) -> str:
        return f"""{name}_either as (select qid, node_id, max(s) as s from (select qid, node_id, 1 as s from {nodes} union all select qid, node_id, 0 from seeds) group by qid, node_id),
{name}_edges as (select a.qid, e.source, e.target, e.description, e.pos from edges e join {name}_either a on a.node_id = e.source join {name}_either b on b.qid = a.qid and b.node_id = e.target
  where e.source <> e.target and a.s + b.s > 0 qualify row_number() over (partition by a.qid, least(e.source, e.target), greatest(e.source, e.target), e.description order by e.pos) = 1),
{name} as (select qid, '- ' || a.title || ' -> ' || b.title || ': ' || r.description as line, cast(row_number() over (partition by qid order by r.pos, 1) as bigint) as n from {name}_edges r join nodes a on a.id = source join nodes b on b.id = target)"""

    head, tail = len(cx.ENTITIES), len(cx.RELATIONSHIPS) + 1
    return recursive(f"""{CONTEXT_SQL},
sized as (select qid, rank, node_id, '- ' || title || ': ' || nodes.description as line, {head} + sum(length('- ' || title || ': ' || nodes.description) + 1) over (partition by qid order by rank) as used from ranks join nodes on id = node_id),
shown as (select * from sized where used <= {cap}), {lines('rl', 'shown')}, {lines('fl', 'sized')},
ent as (select qid, string_agg(line, chr(10) order by rank) as t, string_agg(node_id, ',' order by rank) as ids, max(used) as used from shown group by qid),
rec as (select qid, cast(0 as bigint) as n, cast(used + {tail} as bigint) as size, '' as t from ent union all
  select rec.qid, rl.n, case when size + length(line) + 1 <= {cap} then size + length(line) + 1 else size end, case when size + length(line) + 1 <= {cap} then t || chr(10) || line else t end from rec join rl on rl.qid = rec.qid and rl.n = rec.n + 1),
rels as (select qid, arg_max(t, n) as t from rec group by qid),
part as (select ent.qid, '{cx.ENTITIES}' || chr(10) || ent.t || case when rels.t = '' then '' else chr(10) || '{cx.RELATIONSHIPS}' || rels.t end as context, ids from ent join rels using (qid)),
fe as (select qid, string_agg(line, chr(10) order by rank) as t from sized group by qid), fr as (select qid, string_agg(line, chr(10) order by n) as t from fl group by qid),
whole as (select fe.qid, '{cx.ENTITIES}' || chr(10) || fe.t || case when fr.t is null then '' else chr(10) || '{cx.RELATIONSHIPS}' || chr(10) || fr.t end as context from fe left join fr using (qid))
select part.qid, part.context, ids as context_node_ids, part.context <> whole.context as context_truncated, cast(length(part.context) as integer) as context_characters from part join whole using (qid)""")


@_query(_capped_sql(512))
def context_capped(spark, sf_dir):
    graph, seeds, ranked = _study(spark, sf_dir)
    return cx.study_context(graph, seeds, ranked, seeds, max_chars=512).withColumn("context_node_ids", F.array_join("context_node_ids", ","))


# ---- metrics -----------------------------------------------------------------------------------------------------

LABELS_SQL = "labels as (select 'q' || c_nationkey as qid, 'c' || c_custkey as node_id from customer union all select 'q' || s_nationkey, 's' || s_suppkey from supplier)"


def _labels(spark, sf_dir) -> DataFrame:
    """A nation's customers and suppliers are what its question asks for."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("qid"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    return c.unionAll(read(spark, sf_dir, "supplier").select(F.concat(F.lit("q"), F.col("s_nationkey").cast("string")), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))


def metrics_sql(ranks: str, keys: str = "qid") -> str:
    """CTE m of the five metrics, from a table with rank and node_id."""
    on = " and ".join(f"r.{k} = g.{k}" for k in keys.split(", "))
    return f"""{LABELS_SQL}, wn as (select qid, count(*) as w from labels group by qid),
hits as (select r.*, l.node_id is not null as hit from {ranks} r left join labels l on l.qid = r.qid and l.node_id = r.node_id),
g as (select {keys}, count(*) as n, count(*) filter (hit) as h, min(rank) filter (hit) as f from hits group by {keys}),
m0 as (select g.*, cast(h as double) / n as precision, case when coalesce(w, 0) > 0 then cast(h as double) / w else 0.0 end as recall from g left join wn on wn.qid = g.qid),
m as (select {keys}, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1, case when h > 0 then 1.0 else 0.0 end as hit_rate, case when f is null then 0.0 else cast(1 as double) / f end as reciprocal_rank from m0)"""


def _cast_metrics(keys: str) -> str:
    return f"select {keys}, " + ", ".join(f"round(cast({c} as double), 9) as {c}" for c in me.METRICS) + " from m"


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in me.METRICS})


@_query(f"{propagation_sql(2, 0.6, 20)}, {metrics_sql('ranks')} {_cast_metrics('qid')}")
def retrieval_metrics(spark, sf_dir):
    graph, seeds = graph_of(spark, sf_dir), nation_seeds(spark, sf_dir)
    return _round_metrics(me.retrieval_metrics(seeds, pr.propagate(graph, seeds, Parameters(2, 0.6, 20)), _labels(spark, sf_dir)))


SCORES_SQL = """
arms(arm, k) as (values ('C2', 2), ('C3', 3), ('C4', 4), ('C5', 5), ('C6', 6)),
scores as (select 'c' || c_custkey as qid, c_mktsegment as condition, case c_nationkey % 4 when 0 then 'direct' when 1 then 'comparison' when 2 then 'path' else 'similarity' end as question_type, arm, cast((c_custkey * 7 + k * k * 13) % 101 as double) / 100 as f1 from customer cross join arms)"""


def _scores(spark, sf_dir) -> DataFrame:
    """A score of each arm for every customer, made from its key."""
    arms = spark.createDataFrame([(k, int(k[1])) for k in PAIRS], "arm string, k int")
    kind = F.expr("element_at(array('direct', 'comparison', 'path', 'similarity'), c_nationkey % 4 + 1)")
    f1 = ((F.col("c_custkey") * 7 + F.col("k") * F.col("k") * 13) % 101).cast("double") / 100
    return read(spark, sf_dir, "customer").crossJoin(F.broadcast(arms)).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_mktsegment").alias("condition"), kind.alias("question_type"), "arm", f1.alias("f1"))


@_query(f"""with {SCORES_SQL} select condition, case when grouping(question_type) = 1 then null else question_type end as question_type, cast(grouping(question_type) as integer) as overall, round(avg(f1), 9) as f1
from scores group by grouping sets ((condition), (condition, question_type))""")
def macro_by_type(spark, sf_dir):
    return me.macro_by_type(_scores(spark, sf_dir), columns=("f1",)).withColumn("f1", F.round("f1", 9))


@_query(f"with {SCORES_SQL} select arm, round(avg(f1), 9) as f1 from scores group by arm")
def macro_by_arm(spark, sf_dir):
    return me.macro(_scores(spark, sf_dir), ["arm"], ("f1",)).withColumn("f1", F.round("f1", 9))


@_query(f"""{G}, {TITLES_SQL}, {KEYWORDS_SQL}, pred as (select distinct qid, node_id from keywords join titles on norm = lower(trim(keyword))),
expd as (select distinct p_brand as qid, node_id from part join titles on norm = lower(trim(p_name))),
j as (select coalesce(p.qid, e.qid) as qid, count(*) filter (p.node_id is not null and e.node_id is not null) as tp, count(*) filter (e.node_id is null) as fp, count(*) filter (p.node_id is null) as fn from pred p full join expd e on p.qid = e.qid and p.node_id = e.node_id group by 1),
t as (select count(*) as examples, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, count(*) filter (fp = 0 and fn = 0) as exact_sets from j)
select examples, tp as true_positive, fp as false_positive, fn as false_negative, exact_sets, round(cast(tp as double) / (tp + fp), 9) as precision, round(cast(tp as double) / (tp + fn), 9) as recall,
round(2 * cast(tp as double) / (2 * tp + fp + fn), 9) as f1, round(cast(exact_sets as double) / examples, 9) as exact_set_accuracy from t""")
def mapping_metrics(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    got = mt.exact_match(graph, _keywords(spark, sf_dir))[0].groupBy("qid").agg(F.collect_set("node_id").alias("predicted"))
    wanted = tx.with_folded(read(spark, sf_dir, "part").select(F.col("p_brand").alias("qid"), "p_name"), "p_name", "norm").join(graph.titles, "norm").groupBy("qid").agg(F.collect_set("node_id").alias("expected"))
    return me.mapping_metrics(got.join(wanted, "qid", "full_outer")).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "exact_set_accuracy")})


@_query("""with x as (select o_custkey as q, l_partkey % 10 as id, max(case when l_returnflag = 'R' then 1 else 0 end) as pred, max(case when l_linestatus = 'F' then 1 else 0 end) as rel, max(case when l_returnflag = 'A' then 1 else 0 end) as ctx, max(case when l_linenumber = 1 then 1 else 0 end) as exc
from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
a as (select q, sum(case when pred = 1 and exc = 0 then 1 else 0 end) as p, sum(rel) as r, sum(case when pred = 1 and exc = 0 and rel = 1 then 1 else 0 end) as h, sum(case when pred = 1 and exc = 0 and ctx = 0 then 1 else 0 end) as u from x group by q),
b as (select *, case when p > 0 then cast(h as double) / p else 0.0 end as ep, case when r > 0 then cast(h as double) / r else 0.0 end as er from a)
select cast(q as varchar) as qid, round(cast(ep as double), 9) as entity_precision, round(cast(er as double), 9) as entity_recall, round(cast(case when ep + er > 0 then 2 * ep * er / (ep + er) else 0.0 end as double), 9) as entity_f1, cast(u as integer) as unsupported, round(cast(case when p = 0 then 1.0 else (p - u) / cast(p as double) end as double), 9) as context_faithfulness from b""")
def entity_metrics(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    id_ = (F.col("l_partkey") % 10).cast("string")
    of = lambda c, name: F.array_sort(F.collect_set(F.when(c, id_))).alias(name)
    rows = lines.groupBy(F.col("o_custkey").cast("string").alias("qid")).agg(of(F.col("l_returnflag") == "R", "mentioned"), of(F.col("l_linestatus") == "F", "relevant"), of(F.col("l_returnflag") == "A", "context_ids"), of(F.col("l_linenumber") == 1, "excluded"))
    names = ("entity_precision", "entity_recall", "entity_f1", "context_faithfulness")
    return me.entity_metrics(rows).select("qid", *[F.round(c, 9).alias(c) for c in names], F.size("unsupported_node_ids").alias("unsupported"))


# ---- selection and statistics ------------------------------------------------------------------------------------


@_query(f"""with {SCORES_SQL}, m as (select question_type, arm, round(avg(f1), 12) as mean from scores group by 1, 2) select question_type, arm from m qualify row_number() over (partition by question_type order by mean desc, arm) = 1""")
def selector_train(spark, sf_dir):
    return se.train_selector(_scores(spark, sf_dir))


@_query(f"""with {SCORES_SQL},
w as (select *, round((sum(f1) over (partition by question_type, arm) - f1) / (count(*) over (partition by question_type, arm) - 1), 12) as tm, round((sum(f1) over (partition by arm) - f1) / (count(*) over (partition by arm) - 1), 12) as gm from scores),
t as (select qid, question_type, arm as selected_arm, f1 as selected_f1 from w qualify row_number() over (partition by qid order by tm desc, arm) = 1),
g as (select qid, arm as global_arm, f1 as global_f1 from w qualify row_number() over (partition by qid order by gm desc, arm) = 1)
select qid, question_type, selected_arm, selected_f1, global_arm, global_f1 from t join g using (qid)""")
def leave_one_out(spark, sf_dir):
    return se.leave_one_out(_scores(spark, sf_dir))


@_query(f"with {SCORES_SQL} select round(avg(f), 9) as oracle_mean_f1 from (select max(f1) as f from scores group by qid)")
def oracle_mean(spark, sf_dir):
    return se.oracle_mean(_scores(spark, sf_dir)).withColumn("oracle_mean_f1", F.round("oracle_mean_f1", 9))


def _grid_sql() -> str:
    cells = [(d, x) for d in (1, 2, 3) for x in (0.3, 0.5, 0.6, 0.75)]
    hops = "".join(f", h{i} as (select qid, dst as node_id, sum(mass * share) as mass from h{i - 1} join tr on src = node_id group by qid, dst)" for i in range(1, 4))
    every = " union all ".join(f"select qid, {i} as hop, node_id, mass from h{i}" for i in range(4))
    return f"""with {NODES_SQL}, {EDGES_SQL}, {TR_SQL}, {SEEDS_SQL}{hops}, hm as ({every}),
cells(depth, decay) as (values {', '.join(f'({d}, cast({x} as double))' for d, x in cells)}),
scored as (select qid, depth, decay, node_id, sum(pow(decay, hop) * mass) as score from hm join cells on hop <= depth group by qid, depth, decay, node_id),
listed as (select qid, depth, decay, node_id, cast(row_number() over (partition by qid, depth, decay order by round(score, 12) desc, node_id) as integer) as rank from scored qualify rank <= 20),
ranks as (select listed.*, top_k from listed join (values (5), (10), (20)) k(top_k) on rank <= top_k), {metrics_sql('ranks', 'qid, depth, decay, top_k')}
select cast(depth as integer) as depth, decay, cast(top_k as integer) as top_k, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as f1 from m group by depth, decay, top_k"""


@_query(_grid_sql())
def parameter_grid(spark, sf_dir):
    grid = se.parameter_grid(graph_of(spark, sf_dir), nation_seeds(spark, sf_dir), _labels(spark, sf_dir))
    return grid.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@_query(f"with {SCORES_SQL}, m as (select question_type, arm, round(avg(f1), 12) as mean from scores group by 1, 2), b as (select question_type, arm from m qualify row_number() over (partition by question_type order by mean desc, arm) = 1) select qid, 'C7' as condition, s.arm as reused_from, f1 from scores s join b on b.question_type = s.question_type and b.arm = s.arm")
def arm_reuse(spark, sf_dir):
    s = _scores(spark, sf_dir)
    choices = s.select("qid", "question_type").distinct().join(se.train_selector(s), "question_type")
    return se.reuse_arm(s.select("qid", F.col("arm").alias("condition"), "f1"), choices, "C7").select("qid", "condition", "reused_from", "f1")


@_query("select o_orderpriority as question_type, arg_min(cast(o_orderkey as varchar), sha256('90055:' || o_orderkey)) as qid from orders group by 1")
def hash_sample(spark, sf_dir):
    return se.hash_sample(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.col("o_orderpriority").alias("question_type")))


_DRAWS = se.resamples(25, 200, 90055, 4)


def _bootstrap_sql() -> str:
    """Differences of four arms from C2, by nation; the resampled questions are given as lists."""
    rows = ", ".join(f"('C{k + 3}', {s}, {own})" for k, part in enumerate(_DRAWS) for s, own in enumerate(part))
    return f"""with v as (select 'C' || k as condition, n_nationkey as position, cast((n_nationkey * 17 + k * k * 29) % 97 as double) / 97 as x from nation cross join (values (2), (3), (4), (5), (6)) t(k)),
d as (select a.condition, a.position, a.x - b.x as difference from v a join v b on b.position = a.position and b.condition = 'C2' where a.condition <> 'C2'),
draws(condition, sample, own) as (values {rows}), u as (select condition, sample, unnest(own) as position from draws),
m as (select u.condition, sample, avg(difference) as mean from u join d on d.condition = u.condition and d.position = u.position group by 1, 2),
r as (select condition, mean, row_number() over (partition by condition order by mean) as n from m)
select d.condition, round(avg(difference), 9) as mean_difference, round((select mean from r where r.condition = d.condition and n = 5), 9) as ci95_lower, round((select mean from r where r.condition = d.condition and n = 195), 9) as ci95_upper from d group by d.condition"""


def _bootstrap(spark, sf_dir, **draws):
    arms = spark.createDataFrame([(k,) for k in range(2, 7)], "k int")
    v = read(spark, sf_dir, "nation").crossJoin(F.broadcast(arms)).select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("condition"), F.col("n_nationkey").alias("qid"), (((F.col("n_nationkey") * 17 + F.col("k") * F.col("k") * 29) % 97).cast("double") / 97).alias("f1"))
    d = se.paired_differences(v, "C2").withColumnRenamed("qid", "position")
    return se.bootstrap(d, ["C3", "C4", "C5", "C6"], **draws).withColumns({c: F.round(c, 9) for c in ("mean_difference", "ci95_lower", "ci95_upper")})


@_query(_bootstrap_sql())
def bootstrap_interval(spark, sf_dir):
    return _bootstrap(spark, sf_dir, samples=200, draws=_DRAWS)


@_query()
def bootstrap_interval_whole(spark, sf_dir):
    """bootstrap_interval by the operator's own 10,000 resamples; its draws are too many for SQL."""
    return _bootstrap(spark, sf_dir)


@_query("""select c_mktsegment as condition, case when grouping(c_nationkey) = 1 then null else cast(c_nationkey as varchar) end as dataset, cast(grouping(c_nationkey) as integer) as overall, round(avg(1 + c_custkey % 5), 9) as correctness, round(avg(1 + c_custkey * 3 % 5), 9) as completeness
from customer group by grouping sets ((c_mktsegment), (c_nationkey, c_mktsegment))""")
def judge_means(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("condition"), F.col("c_nationkey").cast("string").alias("dataset"), (1 + F.col("c_custkey") % 5).alias("correctness"), (1 + F.col("c_custkey") * 3 % 5).alias("completeness"))
    return me.judge_means(c).withColumns({x: F.round(x, 9) for x in ("correctness", "completeness")})


from wayfare import more_queries  # noqa: E402, F401  registers its queries here
