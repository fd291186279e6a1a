"""Influence: contagion on hypergraphs, simulated together, and measures of seed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .relational import clique_projection, degree


def linear_threshold(inc: DataFrame, seeds: DataFrame, threshold: float, hops: int) -> DataFrame:
    """(node_id, hop): nodes that become active and when; seeds at 0.

    An inactive hyperedge of a newly active node fires once at least `threshold` of its nodes are active at the start of
    the hop; its nodes are then active. It ends with no new node or no hops left.
    """
    size = cut(inc.join(inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q")), "edge_id").select("edge_id", "node_id", "q"))
    active = cut(seeds.select("node_id").distinct().withColumn("hop", F.lit(0).cast("long")))
    new, fired = active, None
    for hop in range(1, hops + 1):
        near = size.join(new, "node_id", "left_semi").select("edge_id").distinct()
        if fired is not None:
            near = near.join(fired, "edge_id", "left_anti")
        share = size.join(near, "edge_id", "left_semi").join(active, "node_id", "left_semi").groupBy("edge_id", "q").agg(F.count(F.lit(1)).alias("a"))
        firing = cut(share.filter(F.col("a") / F.col("q") >= threshold).select("edge_id"))
        new = cut(size.join(firing, "edge_id", "left_semi").select("node_id").distinct().join(active, "node_id", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        if new.isEmpty():
            break
        active, fired = active.union(new), firing if fired is None else fired.union(firing)
    return active


def uniform(*keys: Column) -> Column:
    """A uniform number in [0, 1) hashed from keys: the same on any partitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / float(1 << 53)


def contact_process(inc: DataFrame, seeds: DataFrame, sims: int, hops: int, p_min: float, p_max: float, seed: int = 0) -> DataFrame:
    """(sim, infected, attempts): every infected node picks one of its hyperedges each hop and tries its other nodes, each with a chance between p_min and p_max.

    All simulations run together. One ends at the first hop without an infection.
    """
    runs, state = _starts(seeds, sims)
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id")) - 1
    numbered = cut(inc.withColumn("nth", nth).join(inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("deg")), "node_id"))
    live, tries = cut(runs), []
    for hop in range(hops):
        now = state.join(live, "sim", "left_semi")
        pick = numbered.select("node_id", "edge_id", "nth", "deg").join(now, "node_id").filter(F.col("nth") == F.floor(uniform(F.col("sim"), F.lit(hop), F.col("node_id"), F.lit(seed)) * F.col("deg")))
        pick = cut(pick.select("sim", F.col("node_id").alias("from"), "edge_id"))
        # Picked hyperedges' nodes that may still be infected, once per simulation: only these meet those that pick.
        left = pick.select("sim", "edge_id").distinct().join(inc, "edge_id").join(state, ["sim", "node_id"], "left_anti")
        reached = pick.join(left, ["sim", "edge_id"])
        rnd = lambda i: uniform(F.col("sim"), F.lit(hop), F.col("from"), F.col("node_id"), F.lit(seed + i))
        tried = cut(reached.select("sim", "node_id", (rnd(1) <= p_min + (p_max - p_min) * rnd(2)).alias("hit")))
        tries.append(tried.groupBy("sim").agg(F.count(F.lit(1)).alias("n")))
        new = cut(tried.filter("hit").select("sim", "node_id").distinct())
        if new.isEmpty():
            break
        live, state = new.select("sim").distinct(), cut(state.union(new))
    return _outcome(runs, state, tries)


def _starts(seeds: DataFrame, sims: int) -> tuple[DataFrame, DataFrame]:
    """(runs, state): simulations, and the nodes that each starts with. seeds (node_id), or (cand, node_id) for several
    candidates, whose simulations are then numbered cand * sims onward, all in one job."""
    if "cand" in seeds.columns:
        first = seeds.select((F.col("cand") * sims).alias("first"), "node_id").distinct()
    else:
        first = seeds.select(F.lit(0).cast("long").alias("first"), "node_id").distinct()
    state = cut(first.select(F.explode(F.sequence(F.col("first"), F.col("first") + sims - 1)).alias("sim"), "node_id"))
    return cut(state.select("sim").distinct()), state


def weighted_cascade(inc: DataFrame, seeds: DataFrame, sims: int, hops: int, seed: int = 0) -> DataFrame:
    """(sim, infected, attempts): newly active nodes try each inactive neighbour once, with a chance of 1 / its degree."""
    c = clique_projection(inc)
    links = c.select("src", "dst").union(c.select("dst", "src"))
    links = cut(links.join(degree(inc).withColumnRenamed("node_id", "dst").withColumnRenamed("value", "deg"), "dst"))
    runs, state = _starts(seeds, sims)
    new = state
    tries = []
    for hop in range(hops):
        reached = new.withColumnRenamed("node_id", "src").join(links, "src").withColumnRenamed("dst", "node_id").join(state, ["sim", "node_id"], "left_anti")
        tried = cut(reached.select("sim", "node_id", (uniform(F.col("sim"), F.lit(hop), F.col("src"), F.col("node_id"), F.lit(seed)) <= 1 / F.col("deg")).alias("hit")))
        tries.append(tried.groupBy("sim").agg(F.count(F.lit(1)).alias("n")))
        new = cut(tried.filter("hit").select("sim", "node_id").distinct())
        if new.isEmpty():
            break
        state = cut(state.union(new))
    return _outcome(runs, state, tries)


def _outcome(runs: DataFrame, state: DataFrame, tries: list[DataFrame]) -> DataFrame:
    infected = state.groupBy("sim").agg(F.count(F.lit(1)).alias("infected"))
    attempts = tries[0]
    for t in tries[1:]:
        attempts = attempts.union(t)
    attempts = attempts.groupBy("sim").agg(F.sum("n").alias("attempts"))
    return runs.join(infected, "sim", "left").join(attempts, "sim", "left").fillna(0, ["infected", "attempts"])


def simulation_stats(outcomes: DataFrame) -> DataFrame:
    """One row: mean, population standard deviation, and all attempts."""
    return outcomes.agg(F.round(F.avg("infected"), 6).alias("mean"), F.round(F.stddev_pop("infected"), 6).alias("std"), F.sum("attempts").alias("attempts"))


def fitness(candidates: DataFrame, n: int, most: int) -> DataFrame:
    """candidates (id, mean, size) -> (id, f1, f2): share of nodes that are influenced, and (most + 1 - size) / most."""
    return candidates.select("id", F.round(F.col("mean") / n, 6).alias("f1"), F.round((most + 1 - F.col("size")) / most, 6).alias("f2"))


def pareto_front(points: DataFrame) -> DataFrame:
    """points (id, f1, f2) that no other is at least as good as in both and better in one. A sweep by f1: no pairs are made.

    A point is dominated by one of larger f1 with f2 no smaller, or of the same f1 with larger f2.
    """
    best = points.groupBy("f1").agg(F.max("f2").alias("top"))
    above = F.max("top").over(Window.orderBy(F.desc("f1")).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("above", above)
    return points.join(best, "f1").filter((F.col("f2") == F.col("top")) & (F.col("above").isNull() | (F.col("f2") > F.col("above")))).select("id", "f1", "f2")


def hypervolume(points: DataFrame) -> DataFrame:
    """One row: the area that points (f1, f2), to be maximized, dominate from (0, 0). One row per distinct f1 goes through the sweep."""
    best = points.groupBy("f1").agg(F.max("f2").alias("f2"))
    w = Window.orderBy(F.desc("f1"))
    s = best.select("f1", F.max("f2").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("h"), F.lead("f1", 1, 0.0).over(w).alias("next"))
    return s.agg(F.round(F.sum((F.col("f1") - F.col("next")) * F.col("h")), 6).alias("hypervolume"))


def high_degree_discount(inc: DataFrame, k: int) -> DataFrame:
    """(order, node_id): k seeds; each time the node of the largest adaptive degree, the smallest id on ties.

    After each pick, every neighbour's degree falls by the number of its own neighbours that are seeds.
    """
    spark = inc.sparkSession
    c = clique_projection(inc)
    links = cut(c.select("src", "dst").union(c.select("dst", "src")))
    deg = cut(degree(inc).withColumnRenamed("value", "d"))
    picked: list[int] = []
    for _ in range(k):
        top = deg.filter(~F.col("node_id").isin(picked)).orderBy(F.desc("d"), "node_id").limit(1).collect()
        if not top:
            break
        picked.append(top[0]["node_id"])
        near = links.filter(F.col("src") == picked[-1]).select(F.col("dst").alias("node_id"))
        z = links.filter(F.col("dst").isin(picked)).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("z"))
        less = near.join(z, "node_id")
        deg = cut(deg.join(less, "node_id", "left").select("node_id", (F.col("d") - F.coalesce("z", F.lit(0))).alias("d")))
    return spark.createDataFrame([(i, x) for i, x in enumerate(picked)], "order long, node_id long")


def node_stats(inc: DataFrame) -> DataFrame:
    """(node_id, mean_size, degree, hyperdegree): what mutations weigh nodes by."""
    size = inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q"))
    s = inc.join(size, "edge_id").groupBy("node_id").agg(F.round(F.avg("q"), 6).alias("mean_size"), F.count(F.lit(1)).alias("hyperdegree"))
    return s.join(degree(inc).withColumnRenamed("value", "degree"), "node_id").select("node_id", "mean_size", "degree", "hyperdegree")


def upscale(seeds: DataFrame, nodes: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """(order, node_id): from the supernodes of seeds (rc), `size` nodes (node_id, rc), taken in turn from each by weights (node_id, value), largest first."""
    m = nodes.join(seeds.select("rc").distinct(), "rc", "left_semi").join(weights, "node_id")
    turn = F.row_number().over(Window.partitionBy("rc").orderBy(F.desc("value"), "node_id"))
    first = m.withColumn("turn", turn).filter(F.col("turn") <= size).orderBy("turn", F.desc("value"), "node_id").limit(size)
    return first.withColumn("order", F.row_number().over(Window.orderBy("turn", F.desc("value"), "node_id")) - 1).select(F.col("order").cast("long"), "node_id")
