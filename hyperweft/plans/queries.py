"""The queries over the star-schema tables, by name, each with the SQL that gives the same rows (none where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rank, relational, summary, traverse
from ..sources import tables
from .lineage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The mappings as SQL: incidence inc(e, v), weights ew(e, w), clusters nc(v, rc) and ecl(e, cc), blocks b.
ORDER = "inc as (select distinct l_orderkey e, l_partkey v from lineitem)"
ORDER_W = ORDER + ", ew as (select l_orderkey e, cast(sum(l_quantity) as bigint) w from lineitem group by 1)"
MIXED = """ev as (select user_id u, date_diff('day', date_trunc('day', min(ts) over ()), date_trunc('day', ts)) d, dense_rank() over (order by event_type) - 1 r from events),
inc as (select distinct u v, d e from ev union select distinct u, 1000 + 5 * d + r from ev),
nc as (select distinct v, v % 10 rc from inc), ecl as (select distinct e, case when e < 1000 then e % 7 else 7 + e % 15 end cc from inc)"""
BLOCKS = MIXED + """, nx as (select rc, count(*) nx from nc group by 1), ny as (select cc, count(*) ny from ecl group by 1),
b as (select rc, cc, count(*) dnz, any_value(nx) nx, any_value(ny) ny, 2 * count(*) >= any_value(nx) * any_value(ny) sel from inc join nc using (v) join ecl using (e) join nx using (rc) join ny using (cc) group by 1, 2)"""
TEMPLATE = BLOCKS + ", t as (select e, v from ecl join b using (cc) join nc using (rc) where sel), plus as (select e, v from inc except select e, v from t), minus as (select e, v from t except select e, v from inc)"
SUPER = BLOCKS + """, mem as (select cc, coalesce(string_agg(cast(rc as varchar), ',' order by rc) filter (sel), '') members, count(rc) filter (sel) k, any_value(n.ny) ny from ny n left join b using (cc) group by 1),
cons as (select min(cc) se_id, members, any_value(k) k, cast(sum(ny) as bigint) weight from mem group by members)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """incidence, node clusters, edge clusters, blocks"""
    inc = tables.mixed_incidence(spark, folder)
    nodes, edges = tables.mixed_node_clusters(inc), tables.mixed_edge_clusters(inc)
    return inc, nodes, edges, summary.block_counts(inc, nodes, edges)


# Representations, projections, samples


@query(f"with {ORDER} select e edge_id, v node_id from inc")
def scan_incidence(spark, folder):
    return tables.order_incidence(spark, folder)


@query("select l_orderkey edge_id, l_partkey node_id, count(*) mult from lineitem group by 1, 2")
def incidence_mult(spark, folder):
    return relational.with_multiplicity(tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id")))


@query(f"with {ORDER} select e id, string_agg(cast(v as varchar), ',' order by v) members, count(*) size from inc group by 1")
def hyperedge_lists(spark, folder):
    return relational.hyperedge_lists(tables.order_incidence(spark, folder))


@query(f"with {ORDER} select v id, string_agg(cast(e as varchar), ',' order by e) members, count(*) size from inc group by 1")
def node_incidence_lists(spark, folder):
    return relational.node_incidence_lists(tables.order_incidence(spark, folder))


@query(f"with {ORDER} select a.v src, b.v dst, count(*) w from inc a join inc b on a.e = b.e and a.v < b.v group by 1, 2")
def clique_projection(spark, folder):
    return relational.clique_projection(tables.order_incidence(spark, folder))


@query(f"with {ORDER} select v src, (select count(distinct v) from inc) + e dst, cast(1 as bigint) w from inc")
def bipartite_projection(spark, folder):
    return relational.bipartite_projection(tables.order_incidence(spark, folder))


@query(f"with {ORDER} select distinct a.e e1, b.e e2 from inc a join inc b on a.v = b.v and a.e < b.e")
def line_graph(spark, folder):
    return relational.line_graph(tables.order_incidence(spark, folder))


@query(
    f"""with {ORDER}, s as (select count(*) s from inc group by e), d as (select count(*) s from inc group by v)
select (select count(*) from d) n, (select count(*) from s) m, (select min(s) from s) min_size, (select round(avg(s), 3) from s) mean_size, (select max(s) from s) max_size,
(select min(s) from d) min_degree, (select round(avg(s), 3) from d) mean_degree, (select max(s) from d) max_degree"""
)
def hypergraph_stats(spark, folder):
    return relational.hypergraph_stats(tables.order_incidence(spark, folder))


@query(f"with {ORDER} select v node_id, count(*) \"value\" from inc group by 1")
def hyperdegree(spark, folder):
    return relational.hyperdegree(tables.order_incidence(spark, folder))


@query(f"with {ORDER_W} select v node_id, cast(sum(w) as bigint) \"value\" from inc join ew using (e) group by 1")
def weighted_degree(spark, folder):
    return relational.weighted_degree(tables.order_incidence(spark, folder), tables.order_weights(spark, folder))


@query(f"with {ORDER} select a.v node_id, count(distinct b.v) - 1 \"value\" from inc a join inc b using (e) group by 1")
def degree(spark, folder):
    return relational.degree(tables.order_incidence(spark, folder))


@query(f"with {ORDER_W}, l as (select e, string_agg(cast(v as varchar), ',' order by v) members from inc group by 1) select members, cast(sum(w) as bigint) weight, count(*) copies from l join ew using (e) group by 1")
def hyperedge_dedup_weighted(spark, folder):
    return relational.dedup_weighted(tables.order_incidence(spark, folder), tables.order_weights(spark, folder))


@query(
    f"""with {ORDER}, r as (select e, row_number() over (order by (e * 2654435761) % 4294967296, e) k, count(*) over () m from (select distinct e from inc))
select e edge_id, v node_id from inc join r using (e) where k <= ceil(0.4 * m)"""
)
def nested_sample(spark, folder):
    return relational.nested_sample(tables.order_incidence(spark, folder), 0.4)


@query(f"with {ORDER} select v node_id from (select distinct v from inc) order by (v * 2654435761) % 4294967296, v limit 100")
def sample_nodes(spark, folder):
    return relational.sample_nodes(tables.order_incidence(spark, folder), 100)


# Summaries


@query(f"with {BLOCKS} select rc, cc, dnz, nx, ny, sel selected from b")
def block_counts(spark, folder):
    return mixed(spark, folder)[3]


@query(
    f"""with {BLOCKS}, m as (select rc, cc // 2 cc, cast(sum(dnz) as bigint) dnz from b group by 1, 2), my as (select cc // 2 cc, cast(sum(ny) as bigint) ny from ny group by 1)
select rc, cc, dnz, nx, ny, 2 * dnz >= nx * ny selected from m join nx using (rc) join my using (cc)"""
)
def block_merge(spark, folder):
    _, nodes, edges, blocks = mixed(spark, folder)
    merged = edges.select("cc").distinct().withColumn("new_cc", F.floor(F.col("cc") / 2))
    return summary.block_merge(blocks, nodes, edges, merged)


@query(f"with {MIXED} select count(distinct e) + count(*) cost from inc")
def original_cost(spark, folder):
    return summary.original_cost(tables.mixed_incidence(spark, folder))


@query(f"with {BLOCKS} select cast(sum(case when sel then nx * ny - dnz else dnz end) as bigint) corrections from b")
def num_corrections(spark, folder):
    return summary.num_corrections(mixed(spark, folder)[3])


@query(f"with {BLOCKS} select cast((select count(*) from ny) + count(*) filter (sel) + sum(case when sel then nx * ny - dnz else dnz end) as bigint) cost from b")
def storage_cost(spark, folder):
    _, _, edges, blocks = mixed(spark, folder)
    return summary.matrix_cost(blocks, edges)


@query(f"with {BLOCKS} select cc se_id, rc sn_id from b where sel")
def superedges(spark, folder):
    return summary.superedges(mixed(spark, folder)[3])


@query(f"with {SUPER} select se_id, members, weight from cons")
def superedge_consolidate(spark, folder):
    _, _, edges, blocks = mixed(spark, folder)
    return summary.consolidated(blocks, edges)


def _corrections(spark, folder):
    inc, nodes, edges, blocks = mixed(spark, folder)
    return inc, nodes, edges, blocks, *summary.corrections(inc, blocks, nodes, edges)


@query(f"with {TEMPLATE} select e edge_id, v node_id from plus")
def corrections_plus(spark, folder):
    return _corrections(spark, folder)[4]


@query(f"with {TEMPLATE} select e edge_id, v node_id from minus")
def corrections_minus(spark, folder):
    return _corrections(spark, folder)[5]


@query(f"with {TEMPLATE} select e edge_id, cast(sum(p) as bigint) n_plus, cast(sum(m) as bigint) n_minus from (select e, 1 p, 0 m from plus union all select e, 0, 1 from minus) group by 1")
def corrections_per_edge(spark, folder):
    return summary.corrections_per_edge(*_corrections(spark, folder)[4:])


@query(f"with {MIXED} select e edge_id, v node_id from inc")
def decode_summary(spark, folder):
    _, nodes, edges, blocks, plus, minus = _corrections(spark, folder)
    return summary.decode(blocks, nodes, edges, plus, minus)


@query("select cast(0 as bigint) mismatches")
def lossless_check(spark, folder):
    inc, nodes, edges, blocks, plus, minus = _corrections(spark, folder)
    return summary.mismatches(inc, summary.decode(blocks, nodes, edges, plus, minus))


COSTS = f"""with {TEMPLATE}, mem as (select cc, coalesce(string_agg(cast(rc as varchar), ',' order by rc) filter (sel), '') members, count(rc) filter (sel) k from ny n left join b using (cc) group by 1),
cons as (select members, any_value(k) k from mem group by members),
c as (select (select count(*) from cons) superedges, (select cast(sum(k) as bigint) from cons) members, (select count(*) from plus) n_plus, (select count(*) from minus) n_minus, (select count(distinct e) + count(*) from inc) original)"""


@query(f"{COSTS} select superedges, members, n_plus + n_minus corrections, cast(0 as bigint) weights, superedges + members + n_plus + n_minus cost from c")
def summary_cost(spark, folder):
    _, _, edges, blocks, plus, minus = _corrections(spark, folder)
    return summary.summary_cost(blocks, edges, plus, minus)


@query(f"{COSTS} select (select count(distinct rc) from nc) node_clusters, (select count(*) from ny) edge_clusters, superedges + members + n_plus + n_minus cost, original original_cost from c")
def evaluate_summary(spark, folder):
    inc, nodes, edges, _ = mixed(spark, folder)
    return summary.evaluate(inc, nodes, edges)


@query(
    f"""{COSTS}, d as (select *, superedges + members + n_plus + n_minus cost from c)
select n_plus, n_minus, round(n_plus / original, 6) plus_of_original, round(n_plus / cost, 6) plus_of_summary, round(n_minus / original, 6) minus_of_original, round(n_minus / cost, 6) minus_of_summary from d"""
)
def correction_distribution(spark, folder):
    inc, _, edges, blocks, plus, minus = _corrections(spark, folder)
    return summary.correction_distribution(inc, plus, minus, summary.summary_cost(blocks, edges, plus, minus))


@query(f"with {BLOCKS}, w as (select rc, sum(ny) s from b where sel group by 1) select v node_id, cast(coalesce(s, 0) as bigint) \"value\" from nc left join w using (rc)")
def hyperdegree_summary(spark, folder):
    _, nodes, edges, blocks = mixed(spark, folder)
    return summary.hyperdegree_in_summary(nodes, blocks, edges)


@query(
    f"""with {BLOCKS}, p as (select distinct x.rc, y.rc o from b x join b y using (cc) where x.sel and y.sel), s as (select p.rc, sum(nx.nx) s from p join nx on nx.rc = p.o group by 1)
select v node_id, cast(coalesce(greatest(s - 1, 0), 0) as bigint) "value" from nc left join s using (rc)"""
)
def degree_summary(spark, folder):
    _, nodes, _, blocks = mixed(spark, folder)
    return summary.degree_in_summary(nodes, blocks)


@query(f"with {MIXED}, f as (select cc, min(e) f from ecl group by 1), r as (select cc, row_number() over (order by f, cc) - 1 new_label from f) select e edge_id, cc, new_label from ecl join r using (cc)")
def relabel_first_seen(spark, folder):
    return relational.first_seen_labels(mixed(spark, folder)[2], "edge_id", "cc").select("edge_id", "cc", "new_label")


@query(f"with {MIXED} select v node_id, rc, row_number() over (order by rc, v) - 1 position from nc")
def cluster_permutation(spark, folder):
    return relational.cluster_permutation(mixed(spark, folder)[1], "node_id", "rc").select("node_id", "rc", "position")


@query(
    f"""with {MIXED}, l as (select e, string_agg(cast(v as varchar), ',' order by v) m from inc group by 1), n as (select e, m, row_number() over (partition by m order by e) k from l)
select a.e edge_id, cc from n a join n b using (m, k) join ecl on ecl.e = b.e"""
)
def edge_clusters_from_summary(spark, folder):
    inc, nodes, edges, blocks, plus, minus = _corrections(spark, folder)
    return summary.edge_clusters_from_decoded(inc, summary.decode(blocks, nodes, edges, plus, minus), edges)


# Searches

#: Query sets are samples, as of sample_nodes: of nodes, and of pairs (the nth nodes of two samples).
SAMPLE = 100
SAMPLED = "select v from (select distinct v from inc) order by ((v + {seed}) * 2654435761) % 4294967296, v limit " + str(SAMPLE)
SOURCES = f"src as ({SAMPLED.format(seed=0)})"
PAIRS = "pairs as (select a.v a, b.v b from " + " join ".join(f"(select v, row_number() over (order by ((v + {i}) * 2654435761) % 4294967296, v) k from (select distinct v from {{inc}})) {x}" for i, x in ((0, "a"), (1, "b"))) + f" using (k) where k <= {SAMPLE})"


def _searched(spark, folder) -> DataFrame:
    """The incidence, made distinct once: a search reads it several times."""
    return stored(tables.order_incidence(spark, folder))


def _sources(inc: DataFrame) -> DataFrame:
    return relational.sample_nodes(inc, SAMPLE)


def _pairs(inc: DataFrame) -> DataFrame:
    """(a, b): the nth nodes of two samples."""

    def numbered(seed: int, name: str) -> DataFrame:
        h = relational.scrambled(F.col("node_id"), seed)
        some = relational.sample_nodes(inc, SAMPLE, seed)
        return some.select(F.col("node_id").alias(name), F.row_number().over(Window.orderBy(h, "node_id")).alias("k"))

    return numbered(0, "a").join(numbered(1, "b"), "k").select("a", "b")


def _bfs_sql(inc: str, sources: str, steps: int = 8) -> str:
    """A frontier per step, and what no step before has seen: d(s, v, d)."""
    out = [inc, sources, "s0 as (select v s, v, 0 d from src)", "a0 as (select * from s0)"]
    for k in range(1, steps + 1):
        out.append(f"s{k} as (select distinct s, i.v, {k} d from s{k - 1} f join inc o on o.v = f.v join inc i on i.e = o.e where (s, i.v) not in (select (s, v) from a{k - 1}))")
        out.append(f"a{k} as (select * from a{k - 1} union all select * from s{k})")
    return "with " + ", ".join(x.replace(" as (", " as materialized (", 1) if x[0] in "as" and x[1].isdigit() else x for x in out) + f", dist as (select * from a{steps})"


ORDER_BFS = _bfs_sql(ORDER, SOURCES)
ORDER_ALL_BFS = _bfs_sql(ORDER, "src as (select distinct v from inc)")
SUPERINC = BLOCKS + ", sinc as (select cc e, rc v from b where sel)"


@query(f"{ORDER_BFS} select s src, v node, cast(d as bigint) dist from dist")
def bfs_distances(spark, folder):
    inc = _searched(spark, folder)
    return traverse.bfs(inc, _sources(inc))


@query(f"{ORDER_BFS}, {PAIRS.format(inc='inc')} select a, b, cast(case when a = b then 0 else coalesce(d, -1) end as bigint) dist from pairs left join dist on s = a and v = b")
def reachability(spark, folder):
    inc = _searched(spark, folder)
    return traverse.reachability(inc, _pairs(inc))


def _super(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Incidence of superedges over supernodes, and the nodes' clusters."""
    _, nodes, _, blocks = mixed(spark, folder)
    return summary.superedges(blocks).select(F.col("se_id").alias("edge_id"), F.col("sn_id").alias("node_id")), nodes


SUPER_BFS = _bfs_sql(SUPERINC.replace("inc as (select distinct u v", "inc0 as (select distinct u v").replace("from inc)", "from inc0)").replace("from inc join nc", "from inc0 join nc") + ", inc as (select e, v from sinc)", "src as (select distinct rc v from nc)", 6)


@query(f"{SUPER_BFS}, {PAIRS.format(inc='nc')}, p as (select a, b, x.rc sa, y.rc sb from pairs join nc x on x.v = a join nc y on y.v = b) select a, b, cast(case when sa = sb then 0 else coalesce(d, -1) end as bigint) dist from p left join dist on s = sa and dist.v = sb")
def reachability_summary(spark, folder):
    superinc, nodes = _super(spark, folder)
    return traverse.reachability_in_summary(superinc, nodes, _pairs(nodes))


def _khop(k: int):
    def run(spark, folder):
        inc = _searched(spark, folder)
        return traverse.khop(inc, _sources(inc), k).withColumn("k", F.lit(k).cast("long"))

    run.__name__ = f"khop_{k}"
    return query(f"{ORDER_BFS} select s src, v neigh, cast({k} as bigint) k from dist where d between 1 and {k}")(run)


def _khop_summary(k: int):
    def run(spark, folder):
        superinc, nodes = _super(spark, folder)
        return traverse.khop_in_summary(superinc, nodes, nodes.select("node_id"), k).withColumn("k", F.lit(k).cast("long"))

    run.__name__ = f"khop_summary_{k}"
    return query(f"{SUPER_BFS} select a.v src, b.v neigh, cast({k} as bigint) k from nc a join dist on s = a.rc join nc b on b.rc = dist.v where d between 1 and {k}")(run)


for _k in (2, 3):
    _khop(_k)
for _k in (2, 3, 4):
    _khop_summary(_k)


@query(f"{ORDER_ALL_BFS} select s src, v neigh, cast(4 as bigint) k from dist where d between 1 and 4")
def khop_4(spark, folder):
    """Of all nodes."""
    return traverse.khop_of_all(_searched(spark, folder), 4).withColumn("k", F.lit(4).cast("long"))


def _labels_sql(inc: str, steps: int = 12) -> str:
    out = [inc, "c0 as (select distinct v, v c from inc)"]
    for k in range(1, steps + 1):
        out.append(f"c{k} as materialized (select v, min(m) c from inc join (select e, min(c) m from inc join c{k - 1} using (v) group by 1) using (e) group by 1)")
    return "with " + ", ".join(out) + f" select v node_id, c comp from c{steps}"


@query(_labels_sql(ORDER))
def connected_components(spark, folder):
    return traverse.connected_components(tables.order_incidence(spark, folder))


@query(f"with recursive {SUPERINC}, reach(s, v) as (select distinct rc, rc from nc union select s, i.v from reach join sinc o on o.v = reach.v join sinc i on i.e = o.e) select v node_id, min(s) comp from reach group by 1")
def connected_components_summary(spark, folder):
    superinc, nodes = _super(spark, folder)
    return traverse.connected_components(superinc, nodes.select(F.col("rc").alias("node_id")).distinct())


CLOSE = "select {0} node_id, cast(sum(d) as bigint) dist_sum, count(*) - 1 reached, case when sum(d) > 0 then round(({1} - 1) / sum(d), 6) else 0.0 end closeness from {2} group by 1"


@query(f"{ORDER_ALL_BFS} " + CLOSE.format("s", "(select count(distinct v) from inc)", "dist"))
def closeness(spark, folder):
    """Of all nodes."""
    inc = _searched(spark, folder)
    return traverse.closeness_of_all(inc, inc.select("node_id").distinct().count())


@query(f"{SUPER_BFS} " + CLOSE.format("nc.v", "(select count(distinct rc) from nc)", "nc join dist on s = nc.rc"))
def closeness_summary(spark, folder):
    superinc, nodes = _super(spark, folder)
    return traverse.closeness_in_summary(superinc, nodes, nodes.select("node_id"))


# Ranks


def _pagerank_sql(graph: str, nodes: str, iterations: int = 10, damping: float = 0.85) -> str:
    """graph: CTEs with g(src, dst, w); nodes: a select of v."""
    out = [graph, f"nodes as ({nodes})", "n as (select count(*) n from nodes)", "o as (select src, sum(w) w from g group by 1)", "r0 as (select v, 1.0::double / n r from nodes, n)"]
    for k in range(1, iterations + 1):
        lost = f"(select coalesce(sum(r), 0) from r{k - 1} where v not in (select src from o))"
        got = f"(select dst v, sum(r * (g.w / o.w)) got from r{k - 1} join g on g.src = r{k - 1}.v join o on o.src = g.src group by 1)"
        out.append(f"r{k} as materialized (select v, {1 - damping} / n + {damping} * (coalesce(got, 0) + {lost} / n) r from nodes cross join n left join {got} using (v))")
    return "with " + ", ".join(out)


GRAPH = ORDER + ", c as (select a.v src, b.v dst, count(*) w from inc a join inc b on a.e = b.e and a.v < b.v group by 1, 2), g as (select * from c union all select dst, src, w from c)"
SUPER_GRAPH = SUPERINC + ", c as (select a.v src, b.v dst, cast(sum(ny) as bigint) w from sinc a join sinc b on a.e = b.e and a.v < b.v join ny on ny.cc = a.e group by 1, 2), g as (select * from c union all select dst, src, w from c)"
BIPARTITE = ORDER + ", g as (select 'n' || v src, 'e' || e dst, 1 w from inc)"


@query(_pagerank_sql(GRAPH, "select distinct v from inc") + " select v node_id, round(r, 6) rank from r10")
def pagerank_graph(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return rank.graph_pagerank(inc, inc.select("node_id").distinct(), 10).withColumn("rank", F.round("rank", 6))


@query(_pagerank_sql(SUPER_GRAPH, "select distinct rc v from nc") + " select nc.v node_id, round(r, 6) rank from nc join r10 on r10.v = nc.rc")
def pagerank_graph_summary(spark, folder):
    _, _, edges, _ = mixed(spark, folder)
    superinc, nodes = _super(spark, folder)
    weights = edges.groupBy(F.col("cc").alias("edge_id")).agg(F.count(F.lit(1)).alias("weight"))
    ranks = rank.graph_pagerank(superinc, nodes.select(F.col("rc").alias("node_id")).distinct(), 10, weights)
    return rank.expand(ranks, nodes).withColumn("rank", F.round("rank", 6))


@query(_pagerank_sql(BIPARTITE, "select distinct src v from g union select distinct dst from g") + " select cast(substr(v, 2) as bigint) node_id, round(r, 6) rank from r10 where v like 'n%'")
def pagerank_bipartite(spark, folder):
    return rank.bipartite_pagerank(tables.order_incidence(spark, folder), 10).withColumn("rank", F.round("rank", 6))


def _diffusion_sql(seeds: str, steps: int, teleport: float = 0.15) -> str:
    """The diffusion from every node s of `seeds`, unrolled; inc(e, v) and ew(e, w) come before."""
    out = ["m as materialized (select e, v, w, sum(w) over (partition by v) wd from inc join ew using (e))", f"st as materialized ({seeds})", "x0 as (select s, s v, 1.0::double x from st)", "act0 as materialized (select distinct s, e from m join st on v = s)"]
    for k in range(1, steps + 1):
        p = k - 1
        out += [
            f"y{k} as materialized (select s, m.e, m.v, w, coalesce(x, 0) / wd y, max(coalesce(x, 0) / wd) over (partition by s, m.e) hi, min(coalesce(x, 0) / wd) over (partition by s, m.e) lo from m join act{p} using (e) left join x{p} using (s, v))",
            f"z{k} as (select *, (y > hi - 1e-8)::int top, (y < lo + 1e-8)::int low, sum((y > hi - 1e-8)::int) over (partition by s, e) tops, sum((y < lo + 1e-8)::int) over (partition by s, e) lows from y{k})",
            f"l{k} as (select s, v, sum(w * (hi - lo) * (top / tops - low / lows)) l from z{k} group by 1, 2)",
            f"w{k} as materialized (select s, v, coalesce(x, 0) x, coalesce(x, 0) - {1 - teleport} * coalesce(l, 0) - {teleport} * (coalesce(x, 0) - (v = s)::int) nw from x{p} full join l{k} using (s, v))",
            f"x{k} as (select s, v, nw x from w{k} where nw >= 1e-5)",
            f"act{k} as materialized (select s, e from act{p} union select s, e from m join w{k} using (v) where x = 0 and nw >= 1e-5)",
        ]
    return ", ".join(out)


#: The nodes that searches start from, as relational.sample_nodes() takes them.
SAMPLED = "select v s from (select distinct v from inc) order by (v * 2654435761) % 4294967296, v limit 100"


@query(f"with {ORDER_W}, {_diffusion_sql(SAMPLED, 3)} select s seed, v node_id, round(x, 5) x from x3")
def pagerank_hypergraph(spark, folder):
    inc = tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id"))
    seeds = relational.sample_nodes(inc, 100)
    return rank.diffusions(inc, tables.order_weights(spark, folder), seeds, 3).withColumn("x", F.round("x", 5))


SUMMARY_GRAPH = f"""{SUPER}, ow as (select se_id e, weight w from cons where members <> ''), home as (select v, rc from nc), pick as (select v from (select distinct v from inc) order by (v * 2654435761) % 4294967296, v limit 100),
inc2 as (select se_id e, cast(unnest(string_split(members, ',')) as bigint) v from cons where members <> '')"""


@query(f"with {SUPER} select se_id edge_id, cast(unnest(string_split(members, ',')) as bigint) node_id, weight from cons where members <> ''")
def summary_hypergraph(spark, folder):
    _, _, edges, blocks = mixed(spark, folder)
    inc, weights = summary.as_hypergraph(blocks, edges)
    return inc.join(weights, "edge_id")


@query(
    f"with {SUMMARY_GRAPH}, "
    + _diffusion_sql("select distinct rc s from home join pick using (v)", 3).replace("from inc join ew using (e)", "from inc2 join ow using (e)")
    + " select a.v seed, b.v node_id, round(x, 5) x from home a join pick on pick.v = a.v join x3 on x3.s = a.rc join home b on b.rc = x3.v"
)
def pagerank_hypergraph_summary(spark, folder):
    inc, nodes, edges, blocks = mixed(spark, folder)
    superinc, weights = summary.as_hypergraph(blocks, edges)
    return rank.personalized_in_summary(superinc, weights, nodes, relational.sample_nodes(inc, 100), 3).withColumn("x", F.round("x", 5))


# Lists and totals


@query(f"with {ORDER}, l as (select e, string_agg(cast(v as varchar), ',' order by v) members, count(*) k from inc group by 1) select members, row_number() over (order by k desc, members) - 1 position from l")
def longest_first(spark, folder):
    lists = relational.hyperedge_lists(tables.order_incidence(spark, folder)).select("members")
    return summary.longest_first(lists)


@query("with o as (select o_orderpriority g, cast(o_orderdate as date) d, count(*) n from orders group by 1, 2) select g, d, n, cast(sum(n) over (partition by g order by d rows unbounded preceding) as bigint) total from o")
def cumulative_totals(spark, folder):
    o = tables.table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return relational.cumulative(o, ["g"], "d", "n")


@query("with o as (select distinct o_custkey v from orders where o_totalprice > 300000) select c_custkey node_id, c_custkey not in (select v from o) isolated from customer")
def isolated_nodes(spark, folder):
    inc = tables.table(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("node_id"))
    return relational.with_isolated(tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("node_id")), inc)
