"""More queries: measures, influence, searches for summaries, files and experiments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import UNIVERSAL
from ..operators import cocluster, influence, metrics, relational, seeds, summary
from ..sources import files, tables
from . import runners
from .lineage import shared_path, stored
from .queries import BLOCKS, MIXED, ORDER, ORDER_W, TEMPLATE, _corrections, mixed, query

# Measures


@query(
    f"""with {ORDER}, sh as (select a.v, b.v u, count(*) s from inc a join inc b using (e) group by 1, 2), q as (select e, count(*) q from inc group by 1), n as (select v, count(*) n from inc group by 1),
dot as (select a.e, a.v, sum(s) d from inc a join inc b using (e) join sh on sh.v = a.v and sh.u = b.v group by 1, 2), ss as (select e, sum(d) s from dot group by 1),
x as (select e, q, case when q > 1 then greatest((q * q * n - 2 * q * d + s)::double / ((q - 1) * (q - 1)), 0) else 0 end dist from dot join q using (e) join n using (v) join ss using (e))
select e edge_id, round(case when q > 1 then sum(exp(-dist / 4.0)) / (q - 1) else 1 end, 6) "value" from x group by e, q"""
)
def hyperedge_weight_eq9(spark, folder):
    w = metrics.hyperedge_weights(metrics.edge_distances(tables.order_incidence(spark, folder)), 4.0)
    return w.select("edge_id", F.round("weight", 6).alias("value"))


def _tens(inc: DataFrame) -> DataFrame:
    return inc.select("node_id").distinct().withColumn("rc", F.col("node_id") % 10)


@query(f"with {ORDER}, c as (select e, v % 10 rc, count(*) n from inc group by 1, 2), r as (select *, row_number() over (partition by e order by n desc, rc) k from c) select e edge_id, rc \"value\" from r where k = 1")
def column_dominant_label(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return metrics.dominant_label(inc, _tens(inc)).withColumnRenamed("label", "value")


SHARES = BLOCKS + ", s as (select rc, cc, dnz / sum(dnz) over () t from b), tx as (select rc, sum(t) tx from s group by 1), ty as (select cc, sum(t) ty from s group by 1), p as (select * from s join tx using (rc) join ty using (cc))"
TAUS = "(sum(t * t / ty) - (select sum(tx * tx) from tx)) / (1 - (select sum(tx * tx) from tx)), (sum(t * t / tx) - (select sum(ty * ty) from ty)) / (1 - (select sum(ty * ty) from ty))"


@query(f"with {SHARES}, g as (select {TAUS.replace('), (sum', ') x, (sum')} y from p) select round(x, 6) tau_x, round(y, 6) tau_y from g")
def goodman_kruskal_tau(spark, folder):
    t = metrics.goodman_kruskal(mixed(spark, folder)[3])
    return t.select(F.round("tau_x", 6).alias("tau_x"), F.round("tau_y", 6).alias("tau_y"))


@query(f"with {SHARES}, g as (select {TAUS.replace('), (sum', ') x, (sum')} y from p) select cast(0 as bigint) mode, round(y, 6) tau from g union all select 1, round(x, 6) from g")
def tensor_tau(spark, folder):
    return metrics.tensor_tau(mixed(spark, folder)[3], ["rc", "cc"], "dnz").withColumn("tau", F.round("tau", 6))


def _star(n: str) -> str:
    """SQL of the universal code of n."""
    terms, x = [f"log2({UNIVERSAL})"], n
    for _ in range(5):
        x = f"(case when {x} > 0 then log2({x}) else 0 end)"
        terms.append(f"greatest({x}, 0)")
    return "(" + " + ".join(terms) + ")"


BITS = "(case when {z} > 0 then -{z} * log2({z} / {s}) else 0 end + case when {s} - {z} > 0 then -({s} - {z}) * log2(({s} - {z}) / {s}) else 0 end)".format(z="dnz::double", s="(nx * ny)::double")


@query(
    f"""with {BLOCKS}, k as (select count(*)::double k, sum(nx * -log2(nx / (select sum(nx) from nx))) a from nx), l as (select count(*)::double l, sum(ny * -log2(ny / (select sum(ny) from ny))) a from ny),
g as (select sum(log2(nx * ny + 1)) g from nx cross join ny), h as (select ceil(round(sum({BITS}), 6)) h from b)
select round({_star('k')} + {_star('l')} + k.a + l.a + g + h, 6) bits from k, l, g, h"""
)
def mdl_cost(spark, folder):
    _, nodes, edges, blocks = mixed(spark, folder)
    return metrics.mdl_cost(blocks, nodes, edges).select(F.round("bits", 6).alias("bits"))


@query(f"with {MIXED}, k as (select count(distinct v)::double n, count(distinct e)::double m from inc) select round({_star('n')} + {_star('m')} + n * log2(n) + m * log2(m) + n * m, 6) bits from k")
def mdl_init_cost(spark, folder):
    return metrics.mdl_init_cost(tables.mixed_incidence(spark, folder)).select(F.round("bits", 6).alias("bits"))


@query(f"with {BLOCKS} select rc, cc, round({BITS}, 6) bits from b")
def entropy_bits(spark, folder):
    b = mixed(spark, folder)[3]
    return b.select("rc", "cc", F.round(metrics.block_bits(b), 6).alias("bits"))


@query(
    f"""with {BLOCKS}, z as (select sum(dnz) z from b), zx as (select rc, sum(dnz) zx from b group by 1), zy as (select cc, sum(dnz) zy from b group by 1),
bb as (select zx.rc, zy.cc, coalesce(dnz, 0) / zy - zx / z b from zx cross join zy cross join z left join b on b.rc = zx.rc and b.cc = zy.cc), o as (select v, cc, count(*) n from inc join ecl using (e) group by 1, 2),
s as (select v, rc, round(sum(n * b), 9) s from o join bb using (cc) group by 1, 2), r as (select *, row_number() over (partition by v order by s desc, rc desc) k from s) select v node_id, rc label from r where k = 1"""
)
def tau_row_move(spark, folder):
    inc, nodes, edges, _ = mixed(spark, folder)
    return metrics.tau_row_move(inc, nodes, edges)


COST = "case when 2 * ({z}) >= ({s}) then 1 + ({s}) - ({z}) else ({z}) end"


@query(
    f"""with {BLOCKS}, p as (select a.cc c1, b.cc c2 from ny a join ny b on a.cc < b.cc),
r as (select p.*, y1.ny y1, y2.ny y2, nx.rc, nx.nx, coalesce(b1.dnz, 0) z1, coalesce(b2.dnz, 0) z2 from p join ny y1 on y1.cc = c1 join ny y2 on y2.cc = c2 cross join nx left join b b1 on b1.cc = c1 and b1.rc = nx.rc left join b b2 on b2.cc = c2 and b2.rc = nx.rc)
select c1, c2, cast(sum({COST.format(z='z1 + z2', s='nx * (y1 + y2)')} - case when z1 > 0 then {COST.format(z='z1', s='nx * y1')} else 0 end - case when z2 > 0 then {COST.format(z='z2', s='nx * y2')} else 0 end) - 1 as bigint) delta
from r where z1 + z2 > 0 group by 1, 2"""
)
def merge_delta_cost(spark, folder):
    _, _, edges, blocks = mixed(spark, folder)
    every = edges.select("cc").distinct()
    pairs = every.select(F.col("cc").alias("c1")).join(every.select(F.col("cc").alias("c2")), F.col("c1") < F.col("c2"))
    return metrics.merge_deltas(blocks, edges, pairs)


@query(f"with {ORDER}, c as (select e, v % 10 rc, count(*) s from inc group by 1, 2), q as (select e, count(*) q from inc group by 1) select v node_id, cast(sum(q - s) as bigint) cost from inc join c on c.e = inc.e and c.rc = v % 10 join q on q.e = inc.e group by 1")
def gahgc_objective(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return metrics.homogeneity_cost(inc, _tens(inc))


WALKS = """w as (select user_id u, event_type x, row_number() over (partition by user_id order by ts, event_id) k from events),
o as (select a.x t, b.x c from w a join w b on a.u = b.u and b.k - a.k between 1 and 2), pr as (select t, c, count(*) n from (select t, c from o union all select c, t from o) group by 1, 2)"""


def _walk_pairs(spark, folder) -> DataFrame:
    e = tables.table(spark, folder, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return metrics.walk_pairs(e.select(F.col("user_id").alias("walk_id"), step.alias("step"), F.col("event_type").alias("item")), 2)


@query(f"with {WALKS} select t target, c context, n from pr")
def walk_pairs(spark, folder):
    return _walk_pairs(spark, folder)


@query(
    f"""with {WALKS}, r as (select t, sum(n) r from pr group by 1), c as (select c, sum(n) s from pr group by 1), v as (select pr.t, pr.c, ln(n * (select sum(n) from pr) / (r * s)::double) x from pr join r using (t) join c using (c))
select t target, c context, round(x, 6) "value" from v where x > 0"""
)
def ppmi(spark, folder):
    return metrics.ppmi(_walk_pairs(spark, folder)).withColumn("value", F.round("value", 6))


@query(
    """with p as (select vec_id i, generate_subscripts(embedding, 1) k, unnest(embedding)::double x from embeddings), d as (select a.i, b.i j, sum((a.x - b.x) * (a.x - b.x)) d from p a join p b on a.k = b.k and a.i <> b.i group by 1, 2),
r as (select i, j, row_number() over (partition by i order by d, j) k from d) select i vec_id, j neighbor_id, k "rank" from r where k <= 5"""
)
def knn_hypergraph(spark, folder):
    return metrics.knn_hypergraph(tables.table(spark, folder, "embeddings"), 5).select("vec_id", "neighbor_id", F.col("rank").cast("long").alias("rank"))


# Influence


def _lt_sql(threshold: float, hops: int) -> str:
    out = [ORDER, "q as (select e, count(*) q from inc group by 1)", "a0 as (select distinct v, 0 hop from inc order by v limit 3)", "n0 as (select v from a0)", "f0 as (select e from inc where false)"]
    for k in range(1, hops + 1):
        out += [
            f"f{k} as materialized (select e from f{k - 1} union select e from (select distinct e from inc where v in (select v from n{k - 1}) and e not in (select e from f{k - 1})) join inc using (e) join q using (e) where v in (select v from a{k - 1}) group by e, q having count(*) / q >= {threshold})",
            f"n{k} as materialized (select distinct v from inc where e in (select e from f{k}) and e not in (select e from f{k - 1}) and v not in (select v from a{k - 1}))",
            f"a{k} as materialized (select * from a{k - 1} union all select v, {k} from n{k})",
        ]
    return "with " + ", ".join(out) + f" select v node_id, cast(hop as bigint) hop from a{hops}"


def _first_nodes(inc: DataFrame, k: int = 3) -> DataFrame:
    return inc.select("node_id").distinct().orderBy("node_id").limit(k)


@query(_lt_sql(0.2, 5))
def im_lt(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return influence.linear_threshold(inc, _first_nodes(inc), 0.2, 5)


def _hdd_sql(k: int) -> str:
    out = [ORDER, "l as (select distinct a.v s, b.v d from inc a join inc b on a.e = b.e and a.v <> b.v)", "d0 as (select v, count(d) d from (select distinct v from inc) left join l on s = v group by 1)", "p0 as (select v, 0 o from inc where false)"]
    for i in range(1, k + 1):
        out += [
            f"t{i} as materialized (select v, {i - 1} o from d{i - 1} where v not in (select v from p{i - 1}) order by d desc, v limit 1)",
            f"p{i} as materialized (select * from p{i - 1} union all select * from t{i})",
            f"z{i} as (select x.d v, count(*) z from l x join l y on y.s = x.d where x.s in (select v from t{i}) and y.d in (select v from p{i}) group by 1)",
            f"d{i} as materialized (select v, d - coalesce(z, 0) d from d{i - 1} left join z{i} using (v))",
        ]
    return "with " + ", ".join(out) + f' select cast(o as bigint) "order", v node_id from p{k}'


@query(_hdd_sql(5))
def hdd_seeds(spark, folder):
    return influence.high_degree_discount(tables.order_incidence(spark, folder), 5)


def _points(inc: DataFrame) -> DataFrame:
    """Objectives that SQL can state: nodes as candidates, their degree as mean, their hyperdegree as size."""
    c = relational.degree(inc).withColumnRenamed("value", "mean").join(relational.hyperdegree(inc).withColumnRenamed("value", "size"), "node_id").withColumnRenamed("node_id", "id")
    n, most = c.agg(F.count(F.lit(1)), F.max("size")).first()
    return influence.fitness(c, n, most)


POINTS = f"""{ORDER}, dg as (select a.v, count(distinct b.v) - 1 m from inc a join inc b using (e) group by 1), hd as (select v, count(*) s from inc group by 1),
pt as (select v id, round(m / (select count(*) from hd), 6) f1, round(((select max(s) from hd) + 1 - s) / (select max(s) from hd), 6) f2 from dg join hd using (v))"""


NATIONS = "inc as (select c_nationkey e, c_custkey v from customer), sd as (select v, e from inc order by v limit 3), q as (select e, count(*) q from inc group by 1), sq as (select e, count(*) k from sd group by 1)"


def _nations(spark, folder) -> DataFrame:
    return tables.table(spark, folder, "customer").select(F.col("c_nationkey").alias("edge_id"), F.col("c_custkey").alias("node_id"))


@query(f"with {NATIONS} select cast(sum(q) as double) mean, 0.0 std, cast(100 * sum(k * (q - k)) as bigint) attempts from sq join q using (e)")
def im_mc_stats(spark, folder):
    """100 simulations where each node has one hyperedge and each attempt succeeds, so that SQL knows the outcome."""
    inc = _nations(spark, folder)
    return influence.simulation_stats(influence.contact_process(inc, _first_nodes(inc), 100, 5, 1.0, 1.0))


@query(f"with {NATIONS}, n as (select count(*) n from inc) select i id, round((select q from inc join q using (e) where v = i) / n, 6) f1 from (select distinct v i from inc order by v limit 10), n")
def im_evaluate(spark, folder):
    """The search's evaluator, on ten candidates of one node each, in a job: as in im_mc_stats, all of a nation are reached."""
    inc = _nations(spark, folder)
    picked = [r["node_id"] for r in _first_nodes(inc, 10).collect()]
    shares, _ = seeds.evaluate(inc, [(x,) for x in picked], inc.count(), "sicp", 100, 5, p_min=1.0, p_max=1.0)
    return spark.createDataFrame([(i, round(f, 6)) for i, f in zip(picked, shares, strict=True)], "id long, f1 double")


@query(f"with {POINTS} select id, f1, f2 from pt")
def im_fitness(spark, folder):
    return _points(tables.order_incidence(spark, folder))


@query(f"with {POINTS} select id, f1, f2 from pt p where not exists (select 1 from pt q where q.f1 >= p.f1 and q.f2 >= p.f2 and (q.f1 > p.f1 or q.f2 > p.f2))")
def pareto_front(spark, folder):
    return influence.pareto_front(_points(tables.order_incidence(spark, folder)))


@query(
    f"""with {POINTS}, b as (select f1, max(f2) f2 from pt group by 1), s as (select f1, max(f2) over (order by f1 desc rows unbounded preceding) h, coalesce(lead(f1) over (order by f1 desc), 0) nx from b) select round(sum((f1 - nx) * h), 6) hypervolume from s"""
)
def hypervolume(spark, folder):
    return influence.hypervolume(_points(tables.order_incidence(spark, folder)))


@query(
    f"""with {ORDER}, q as (select e, count(*) q from inc group by 1), s as (select v, round(avg(q), 6) mean_size, count(*) hyperdegree from inc join q using (e) group by 1), d as (select a.v, count(distinct b.v) - 1 degree from inc a join inc b using (e) group by 1)
select v node_id, mean_size, degree, hyperdegree from s join d using (v)"""
)
def node_order_stats(spark, folder):
    return influence.node_stats(tables.order_incidence(spark, folder))


@query()
def im_sicp(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return influence.simulation_stats(influence.contact_process(inc, _first_nodes(inc), 20, 4, 0.2, 0.6))


@query()
def im_wc(spark, folder):
    inc = tables.order_incidence(spark, folder)
    return influence.simulation_stats(influence.weighted_cascade(inc, _first_nodes(inc), 20, 4))


@query()
def im_search(spark, folder):
    """Archive and last population; fewer candidates, generations and simulations than the operator's defaults."""
    found, last, _ = seeds.search(tables.order_incidence(spark, folder), most=10, population=6, offspring=6, generations=1, sims=5, hops=3, mutation_kind="mix")
    return found.withColumn("kind", F.lit("archive")).union(last.withColumn("kind", F.lit("population")))


@query(
    f"""with {MIXED}, hd as (select v, count(*) s from inc group by 1), r as (select v, s, row_number() over (partition by rc order by s desc, v) t from nc join hd using (v) where rc in (1, 4, 7)), o as (select v, row_number() over (order by t, s desc, v) - 1 o from r)
select o "order", v node_id from o where o < 7"""
)
def upscale_seeds(spark, folder):
    inc, nodes, _, _ = mixed(spark, folder)
    chosen = nodes.filter("rc in (1, 4, 7)").select("rc").distinct()
    return influence.upscale(chosen, nodes, relational.hyperdegree(inc), 7)


# Searches for summaries: their results are checked by what must hold


def _linear(key: str, n: int) -> str:
    factor, summand = relational.linear_terms(n)
    return f"((({key}) % {relational.PRIME}) * {factor} + {summand}) % {relational.PRIME}"


def _groups_sql(rows: int, bands: int, key: str) -> str:
    sigs = ", ".join("concat_ws(',', " + ", ".join([str(b), *[f"h{b * rows + i}" for i in range(rows)]]) + ")" for b in range(bands))
    return f"s as (select {key}, unnest([{sigs}]) g from h), l as (select g, min({key}) l from s group by 1) select {key}{' edge_id' if key == 'e' else ''}, min(l) \"group\" from s join l using (g) group by 1"


@query(f"with {ORDER}, h as (select e, " + ", ".join(f"min({_linear('v', i)}) h{i}" for i in range(6)) + f" from inc group by 1), {_groups_sql(2, 3, 'e')}")
def lsh_minhash_groups(spark, folder):
    return cocluster.minhash_groups(tables.order_incidence(spark, folder), 2, bands=3)


def _normal(i: int) -> str:
    u = lambda j: f"(({_linear('rc', 2 * i + j)}) + 0.5) / {relational.PRIME}.0"
    return f"sqrt(-2 * ln({u(0)})) * cos({2 * math.pi!r} * ({u(1)}))"


@query(f"with {BLOCKS}, h as (select cc, " + ", ".join(f"cast(sign(round(sum(dnz / (nx * ny) * {_normal(i)}), 9)) as int) h{i}" for i in range(12)) + f" from b group by 1), {_groups_sql(4, 3, 'cc')}")
def lsh_cosine_groups(spark, folder):
    return cocluster.cosine_groups(mixed(spark, folder)[3], 4, bands=3)


def _invariants(inc: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of what holds for any clusters: each node and hyperedge in one, block counts add up, and the summary decodes to the original."""
    blocks = summary.block_counts(inc, nodes, edges)
    plus, minus = summary.corrections(inc, blocks, nodes, edges)
    rows = [
        inc.select("node_id").distinct().join(nodes, "node_id").agg((F.count(F.lit(1)) == F.count_distinct("node_id")).alias("nodes_once")),
        inc.select("edge_id").distinct().join(edges, "edge_id").agg((F.count(F.lit(1)) == F.count_distinct("edge_id")).alias("edges_once")),
        blocks.agg(F.sum("dnz").alias("z")).join(inc.agg(F.count(F.lit(1)).alias("nnz"))).select((F.col("z") == F.col("nnz")).alias("counts_add_up")),
        summary.mismatches(inc, summary.decode(blocks, nodes, edges, plus, minus)).select((F.col("mismatches") == 0).alias("lossless")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))
    return out


HOLDS = "select true nodes_once, true edges_once, true counts_add_up, true lossless"


@query(HOLDS + ", true cost_falls, true below_original")
def storage_invariants(spark, folder):
    """The search on the mixed hypergraph, in at most two rounds of each kind: its state holds, and its summary costs less than the original."""
    inc = tables.mixed_incidence(spark, folder)
    nodes, edges, costs = cocluster.search(inc, "storage", max_rounds=2, last_bands=10)
    row = summary.evaluate(inc, nodes, edges).first()
    return _invariants(inc, nodes, edges).withColumns({"cost_falls": F.lit(costs == sorted(costs, reverse=True)), "below_original": F.lit(row["cost"] < row["original_cost"])})


@query("select true near_planted, true lossless")
def storage_planted(spark, folder):
    """A planted hypergraph, a part of its entries flipped: the search comes within a tenth of the planted summary's cost."""
    inc, nodes, edges = runners.planted(spark, 4, 3, 8, 0.02)
    best = summary.evaluate(inc, nodes, edges).first()["cost"]
    n, e, _ = cocluster.search(inc, "storage", max_rounds=2, last_bands=10)
    found = summary.evaluate(inc, n, e).first()["cost"]
    return _invariants(inc, n, e).select(F.lit(found <= 1.1 * best).alias("near_planted"), "lossless")


@query(HOLDS + ", true cost_falls")
def coclus_invariants(spark, folder):
    inc = tables.mixed_incidence(spark, folder)
    nodes, edges, costs = cocluster.search(inc, "mdl", max_rounds=1, last_bands=10)
    return _invariants(inc, nodes, edges).withColumn("cost_falls", F.lit(costs == sorted(costs, reverse=True)))


@query(f"with {ORDER}, n as (select count(distinct v) n from inc) select cast(k as bigint) label, case when k < 7 then n // 8 else n - 7 * (n // 8) end n from n, range(8) t(k)")
def random_clusters_equal(spark, folder):
    return cocluster.random_clusters(tables.order_incidence(spark, folder), "node_id", 8).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(HOLDS)
def gahgc_invariants(spark, folder):
    inc = stored(tables.mixed_incidence(spark, folder))
    return _invariants(inc, *cocluster.gahgc(inc, 6, n_walks=4, length=6, max_iterations=1))


@query(HOLDS + ", true objective_falls")
def dhcc_invariants(spark, folder):
    inc, _, _ = runners.planted(spark, 4, 3, 6, 0.02)
    nodes, edges, objective = cocluster.dhcc(inc, 4, 4, iterations=3)
    return _invariants(inc, nodes, edges).withColumn("objective_falls", F.lit(objective[-1] <= objective[0] + 1e-6))


NEIGHBOURS = """nat as (select distinct s_nationkey v, s_suppkey % 50 e from supplier), sz as (select v, count(*) s from nat group by 1), bo as (select a.v, b.v u, count(*) n from nat a join nat b using (e) where a.v <> b.v group by 1, 2),
ds as (select x.v, y.v u, x.s + y.s - 2 * coalesce(n, 0) d from sz x join sz y on x.v <> y.v left join bo on bo.v = x.v and bo.u = y.v), kn as (select v, u, d::double d, row_number() over (partition by v order by d, u) k from ds)"""


def _neighbours(spark, folder) -> DataFrame:
    inc = tables.table(spark, folder, "supplier").select((F.col("s_suppkey") % 50).alias("edge_id"), F.col("s_nationkey").alias("node_id")).distinct()
    return metrics.sparse_neighbours(inc, 3)


@query(f"with {NEIGHBOURS} select v node_id, u neighbor_id, cast(k as int) \"rank\", d from kn where k <= 3")
def sparse_neighbours(spark, folder):
    return _neighbours(spark, folder)


AFFINITY = f"""{NEIGHBOURS}, m as (select v e, u a, d from kn where k <= 3 union all select distinct v, v, 0 from kn), mm as (select e, avg(d) mean from m group by 1),
w as (select e, sum(case when mean > 0 then exp(-d / mean) else 1 end) w, count(*) n from m join mm using (e) group by 1)"""


@query(f"with {AFFINITY} select x.a, y.a b, round(sum(w / n), 6) w from m x join m y using (e) join w using (e) group by 1, 2")
def knn_affinity(spark, folder):
    return metrics.affinity(_neighbours(spark, folder))[0].withColumn("w", F.round("w", 6))


@query(f"with {AFFINITY} select a, round(sum(w), 6) degree from m join w using (e) group by 1")
def knn_vertex_degree(spark, folder):
    return metrics.affinity(_neighbours(spark, folder))[1].withColumn("degree", F.round("degree", 6))


@query(HOLDS)
def tau_invariants(spark, folder):
    inc, _, _, _ = mixed(spark, folder)
    nodes, edges, _ = cocluster.tau_search(inc, 6, 5, max_iterations=3)
    return _invariants(inc, nodes, edges)


TENSOR = """ev as (select user_id u, date_diff('day', date_trunc('day', min(ts) over ()), date_trunc('day', ts)) d, dense_rank() over (order by event_type) - 1 r from events), t as (select u, r, d, count(*) val from ev group by 1, 2, 3),
cu as (select distinct u, u % 4 lu from t), cr as (select distinct r, r % 2 lr from t), cd as (select distinct d, d % 3 ld from t)"""


def _tensor(spark, folder) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Events by user, rank of type and day, with fixed clusters of each."""
    e = tables.table(spark, folder, "events")
    first = e.agg(F.min(F.to_date("ts"))).first()[0]
    ranks = {r["event_type"]: i for i, r in enumerate(e.select("event_type").distinct().orderBy("event_type").collect())}
    r = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("event_type")]
    t = e.select(F.col("user_id").alias("u"), r.cast("long").alias("r"), F.datediff(F.to_date("ts"), F.lit(first)).cast("long").alias("d")).groupBy("u", "r", "d").agg(F.count(F.lit(1)).alias("val"))
    return t, {m: t.select(m).distinct().withColumn("label", F.col(m) % k) for m, k in (("u", 4), ("r", 2), ("d", 3))}


@query(
    f"""with {TENSOR}, o as (select u, lr, ld, sum(val) val from t join cr using (r) join cd using (d) group by 1, 2, 3), z as (select lu, lr, ld, sum(val) z from o join cu using (u) group by 1, 2, 3), zy as (select lr, ld, sum(z) zy from z group by 1, 2), x as (select lu, sum(z) / (select sum(z) from z) s from z group by 1),
g as (select u, x.lu, round(sum(val * (coalesce(z, 0) / zy - s)), 9) g from o join zy using (lr, ld) cross join x left join z on z.lu = x.lu and z.lr = o.lr and z.ld = o.ld group by 1, 2)
select u, lu "label" from (select *, row_number() over (partition by u order by g desc, lu desc) k from g) where k = 1"""
)
def tensor_move(spark, folder):
    t, held = _tensor(spark, folder)
    return metrics.tensor_move(t, ["u", "r", "d"], "u", held)


@query("select true every_item_once, true tau_rises")
def tensor_invariants(spark, folder):
    t, _ = _tensor(spark, folder)
    held, (before, after), _ = cocluster.tensor_search(t, ["u", "r", "d"], [4, 2, 3], max_iterations=1, per_mode=3)
    once = all(held[m].count() == t.select(m).distinct().count() for m in held)
    total = lambda x: x.agg(F.sum("tau")).first()[0]
    return spark.createDataFrame([(once, total(after) >= total(before) - 1e-9)], "every_item_once boolean, tau_rises boolean")


ICM = f"""{ORDER_W}, nd as (select distinct v, v % 10 rc, [(v % 7)::double, (v % 11)::double] x from inc), cen as (select rc, avg(x[1]) c1, avg(x[2]) c2 from nd group by 1)"""


def _icm(spark, folder) -> tuple:
    inc = tables.order_incidence(spark, folder)
    nodes = inc.select("node_id").distinct()
    vectors = nodes.select("node_id", F.array((F.col("node_id") % 7).cast("double"), (F.col("node_id") % 11).cast("double")).alias("v"))
    nodes = nodes.withColumn("rc", F.col("node_id") % 10)
    return inc, vectors, nodes, metrics.centers(vectors, nodes), tables.order_weights(spark, folder)


@query(
    f"""with {ICM}, f as (select sum((x[1] - c1) ** 2 + (x[2] - c2) ** 2) f from nd join cen using (rc)), c as (select e, rc, count(*) n from inc join nd using (v) group by 1, 2), p as (select e, sum(n) q, sum(n * (n - 1) / 2) s from c group by 1)
select round(f + 0.5 * sum(w * (q * (q - 1) / 2 - s)), 4) objective from p join ew using (e), f group by f"""
)
def icm_objective(spark, folder):
    return metrics.icm_objective(*_icm(spark, folder), 0.5).select(F.round("objective", 4).alias("objective"))


@query(
    f"""with {ICM}, c as (select e, rc, count(*) n from inc join nd using (v) group by 1, 2), sz as (select e, count(*) q from inc group by 1), ev as (select v, sum(w * (q - 1)) a, sum(w) own from inc join sz using (e) join ew using (e) group by 1), nr as (select v, rc, sum(w * n) b from inc join ew using (e) join c using (e) group by 1, 2),
k as (select nd.v, cen.rc, round((x[1] - c1) ** 2 + (x[2] - c2) ** 2 + 0.5 * (a - coalesce(b, 0) + case when cen.rc = nd.rc then own else 0 end), 9) k from nd cross join cen join ev on ev.v = nd.v left join nr on nr.v = nd.v and nr.rc = cen.rc)
select v node_id, rc "label" from (select *, row_number() over (partition by v order by k, rc) o from k) where o = 1"""
)
def icm_move(spark, folder):
    return metrics.icm_move(*_icm(spark, folder), 0.5)


@query("select true objective_falls, true none_empty")
def icm_invariants(spark, folder):
    inc, vectors, nodes, _, weights = _icm(spark, folder)
    found, history = cocluster.icm(inc, vectors, weights, 10, start=nodes, max_iterations=1)
    falls = all(a >= b - 1e-6 for a, b in zip(history, history[1:], strict=False))
    return found.agg((F.count_distinct("rc") == 10).alias("none_empty")).select(F.lit(falls).alias("objective_falls"), "none_empty")


# Files and experiments


@query(
    f"""with {TEMPLATE}, mem as (select cc, coalesce(string_agg(cast(rc as varchar), ',' order by rc) filter (sel), '') members, any_value(n.ny) ny from ny n left join b using (cc) group by 1),
cons as (select min(cc) se, members, cast(sum(ny) as bigint) w from mem group by members), pl as (select e, string_agg(cast(v as varchar), ' ' order by v) p from plus group by 1), mi as (select e, string_agg(cast(v as varchar), ' ' order by v) m from minus group by 1)
select 'V' section, cast(rc as varchar) "key", cast(v as varchar) "value" from nc union all select 'E', members, cast(w as varchar) from cons union all select 'C', coalesce(p, ''), coalesce(m, '') from pl full join mi using (e)"""
)
def summary_roundtrip(spark, folder):
    inc, nodes, edges, blocks, plus, minus = _corrections(spark, folder)
    listed = lambda x, name: x.groupBy("edge_id").agg(relational.as_list(F.collect_list("node_id")).alias(name))
    c = listed(plus, "plus").join(listed(minus, "minus"), "edge_id", "full").fillna("").join(edges, "edge_id").join(summary.edge_to_superedge(blocks, edges).select("cc", "se_id"), "cc")
    path = shared_path(spark)
    files.write_summary(files.summary_lines(nodes, summary.consolidated(blocks, edges), c.select("se_id", "edge_id", "plus", "minus")), path)
    v, e, c = files.read_summary(spark, path)
    out = v.select(F.lit("V").alias("section"), F.col("sn_id").cast("string").alias("key"), F.col("node_key").alias("value"))
    return out.union(e.select(F.lit("E"), "members", F.col("weight").cast("string"))).union(c.select(F.lit("C"), "plus", "minus"))


#: (dataset, candidate, seed, cost, original, seconds, status) of some runs.
RUNS = [("a", 1, 0, 50.0, 100.0, 2.0, "ok"), ("a", 1, 1, 60.0, 100.0, 3.0, "ok"), ("b", 1, 0, 30.0, 60.0, 1.0, "ok"), ("b", 1, 1, 36.0, 60.0, 1.0, "ok"), ("a", 2, 0, 40.0, 100.0, 5.0, "ok"), ("a", 2, 1, 50.0, 100.0, 5.0, "ok"), ("b", 2, 0, 33.0, 60.0, 4.0, "ok"), ("b", 2, 1, 39.0, 60.0, 4.0, "ok"), ("a", 3, 0, 10.0, 100.0, 1.0, "ok"), ("b", 3, 0, 9.0, 60.0, 1.0, "error")]
VALUES = "runs as (select * from (values " + ", ".join(str(r) for r in RUNS) + ") t(dataset, candidate, seed, cost, original, seconds, status))"


def _runs(spark) -> DataFrame:
    return spark.createDataFrame(RUNS, "dataset string, candidate long, seed long, cost double, original double, seconds double, status string")


@query(f"with {VALUES} select dataset, cast(candidate as bigint) candidate, count(*) runs, round(avg(cost), 6) mean, round(coalesce(stddev_samp(cost), 0), 6) std from runs where status = 'ok' group by 1, 2")
def run_aggregate(spark, folder):
    return runners.aggregate_runs(_runs(spark), ["dataset", "candidate"], "cost")


@query(
    f"""with {VALUES}, k as (select count(*) k from (select distinct dataset, seed from runs)), f as (select candidate from runs group by 1 having count(*) = (select k from k)), p as (select candidate, dataset, avg(cost / original) s, avg(seconds) t from runs where candidate in (select candidate from f) group by 1, 2)
select cast(candidate as bigint) candidate, round(avg(s), 6) score, round(avg(t), 6) as "seconds" from p group by 1 order by 2, 3, 1 limit 1"""
)
def tuning_select(spark, folder):
    return runners.select_candidate(_runs(spark).select("candidate", "dataset", "seed", "cost", "original", "seconds"))


def _sql_values(options: dict[str, list]) -> str:
    return ", ".join(f"(select unnest({v}) {k})" for k, v in options.items())


@query(
    f"""with g as (select row_number() over (order by alpha, length, n_walks) - 1 candidate, alpha, length::double length, n_walks::double n_walks from {_sql_values(runners.FULL["gahgc"])}) select * from g"""
)
def candidate_grid(spark, folder):
    return runners.candidate_grid(spark, runners.FULL["gahgc"])


@query("select 'dhcc' algorithm, 'compact' search, 4 * 4 n union all select 'dhcc', 'full', 10 * 7 * 7 union all select 'gahgc', 'compact', 1 + 3 * 2 union all select 'gahgc', 'full', 3 * 3 * 3")
def candidate_counts(spark, folder):
    rows = [(a, how, len(runners.candidates(a, how))) for a in ("dhcc", "gahgc") for how in ("compact", "full")]
    return spark.createDataFrame(rows, "algorithm string, search string, n int")


@query(f"with {VALUES}, w as (select d dataset, c candidate, s seed from (values ('a'), ('b')) x(d), (values (1), (2), (3)) y(c), (values (0), (1)) z(s)) select dataset, cast(candidate as bigint) candidate, cast(seed as bigint) seed from w where (dataset, candidate, seed) not in (select (dataset, candidate, seed) from runs where status = 'ok')")
def resume_antijoin(spark, folder):
    wanted = spark.createDataFrame([(d, c, s) for d in "ab" for c in (1, 2, 3) for s in (0, 1)], "dataset string, candidate long, seed long")
    return files.remaining(wanted, _runs(spark).filter("status = 'ok'"), ["dataset", "candidate", "seed"])


@query(f"with {VALUES}, b as (select dataset, min(cost) best from runs group by 1) select dataset, cast(candidate as bigint) candidate, cast(seed as bigint) seed, cost::double cost, best::double best, round((cost - best) / cost, 6) increase from runs join b using (dataset)")
def increase_ratio(spark, folder):
    runs = _runs(spark)
    keyed = runs.select("dataset", "candidate", "seed", "cost")
    best = runs.groupBy("dataset").agg(F.min("cost").alias("cost"))
    planted = keyed.drop("cost").join(best, "dataset")
    return runners.increase(keyed, planted, ["dataset", "candidate", "seed"])


@query(
    f"""with {ORDER}, r as (select e, row_number() over (order by (e * 2654435761) % 4294967296, e) k, count(*) over () m from (select distinct e from inc)), f as (select unnest([0.2, 0.6, 1.0])::double f),
s as (select f, v, e from f join r on k <= ceil(f * m) join inc using (e)) select f fraction, count(distinct v) n, count(distinct e) m, count(*) nnz, round(count(*) / (count(distinct v) * count(distinct e)), 9) density, count(distinct e) + count(*) original_cost from s group by 1"""
)
def scalability_inputs(spark, folder):
    return runners.scalability_inputs(tables.order_incidence(spark, folder), (0.2, 0.6, 1.0))


@query("select algorithm, cast(1 as bigint) runs, true ok, true cheaper from (values ('random'), ('storage'), ('tau')) t(algorithm)")
def summarize_grid(spark, folder):
    """Three algorithms on a planted hypergraph: all end well, none above twice the original's cost."""
    inc, _, _ = runners.planted(spark, 4, 3, 6, 0.02)
    g = runners.grid({"planted": inc}, {"random": {"k": 4, "l": 4}, "storage": {"max_rounds": 1, "last_bands": 5}, "tau": {"k": 4, "l": 4, "max_iterations": 2}}, [1])
    return g.groupBy("algorithm").agg(F.count(F.lit(1)).alias("runs"), (F.min("status") == "ok").alias("ok"), (F.max(F.col("cost") / F.col("original_cost")) < 2).alias("cheaper"))


@query("select cast(f as double) fraction, s seed, 'ok' status, true improves from (select unnest([0.5, 1.0]) f), (select unnest([0, 1]) s)")
def scalability_runs(spark, folder):
    inc, _, _ = runners.planted(spark, 4, 3, 12, 0.02)
    r = runners.scalability(inc, (0.5, 1.0), [0, 1], max_rounds=1, last_bands=5)
    return r.select("fraction", F.col("seed").cast("int").alias("seed"), "status", ((F.col("improvement") > 0) & (F.col("column_rounds") > 0) & (F.col("seconds") > 0)).alias("improves"))


@query("select cast(4 as bigint) runs, cast(0 as bigint) repeated, true best_is_least")
def tuning_run(spark, folder):
    """A tuning run that is resumed: two candidates with two seeds; the second call runs nothing again."""
    inc, _, _ = runners.planted(spark, 3, 3, 6, 0.02)
    options, path = [{"k": 2, "l": 2}, {"k": 9, "l": 3}], shared_path(spark)
    before = runners.tune({"planted": inc}, "random", options, [0, 1], path)[0].count()
    runs, best = runners.tune({"planted": inc}, "random", options, [0, 1], path)
    means = runs.groupBy("candidate").agg(F.avg(F.col("cost") / F.col("original")).alias("m")).agg(F.min_by("candidate", "m").alias("c")).first()["c"]
    row = (runs.count(), runs.count() - before, best.first()["candidate"] == means)
    return spark.createDataFrame([row], "runs long, repeated long, best_is_least boolean")


@query()
def influence_run(spark, folder):
    """A search on the summary of the mixed hypergraph, its sets upscaled to users and simulated there."""
    inc, nodes, edges, blocks = mixed(spark, folder)
    superinc, _ = summary.as_hypergraph(blocks, edges)
    out = runners.influence_run(superinc, 3, original=inc, nodes=nodes, sims=4, hops=2, population=4, offspring=4, generations=1)
    return out.select("kind", "id", "seeds", "seed_percent", "influenced_percent", "influenced_std")


@query("select 'random' algorithm, 2 n, true above_planted")
def synthetic_runs(spark, folder):
    r = runners.synthetic(spark, [(4, 3, 6, 0.0)], {"random": {"k": 4, "l": 4}}, [0, 1])
    return r.groupBy("algorithm").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("increase") >= 0).alias("above_planted"))
