"""PageRank on the clique and bipartite projections, and nonlinear diffusion on the hypergraph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored

#: Values of a block of a diffusion's seeds, which tasks hold in memory, and the most blocks, each of which reads all hyperedges.
FEW, BLOCKS = 4_000_000, 16


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node_id, rank) by power iteration from uniform ranks with uniform teleport; dangling ranks are spread evenly.

    nodes (node_id); edges (src, dst, w) directed. With a tolerance, iterations end once ranks change less in sum.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    links = cut(edges.join(out, "src").select("src", F.col("dst").alias("node_id"), (F.col("w") / F.col("out")).alias("p")))
    rank = cut(nodes.withColumn("rank", F.lit(1.0 / n)))
    sinks = cut(nodes.join(out.select(F.col("src").alias("node_id")), "node_id", "left_anti"))
    for _ in range(iterations):
        lost = rank.join(sinks, "node_id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = links.join(rank.withColumnRenamed("node_id", "src"), "src").groupBy("node_id").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = rank.join(got, "node_id", "left").join(F.broadcast(lost))
        new = cut(new.select("node_id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), F.col("rank").alias("old")))
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) < tolerance:
            rank = new.drop("old")
            break
        rank = new.drop("old")
    return rank


def graph_pagerank(inc: DataFrame, nodes: DataFrame, iterations: int, weights: DataFrame | None = None, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """pagerank() on the undirected clique projection of an incidence, whose links are never made.

    A link's weight is that of the hyperedges shared, so a node's neighbours give it, through each of its hyperedges, the
    sum of rank / out over all members, less its own part. Two hops over the incidence make an iteration. nodes (node_id):
    also those without hyperedges; weights (edge_id, weight): 1 each by default.
    """
    n = nodes.count()
    w = inc.select("edge_id", "node_id")
    w = w.withColumn("weight", F.lit(1)) if weights is None else w.join(weights, "edge_id")
    w = cut(w.join(inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q")), "edge_id"))
    own = w.groupBy("node_id").agg(F.sum(F.col("weight") * (F.col("q") - 1)).alias("out"), F.sum("weight").alias("own"))
    state = nodes.select("node_id").distinct().join(own, "node_id", "left").fillna(0, ["out", "own"])
    state = cut(state.withColumn("rank", F.lit(1.0 / n)))
    w = w.select("edge_id", "node_id", "weight")
    for _ in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0))).first()[0]
        part = F.when(F.col("out") > 0, F.col("rank") / F.col("out")).otherwise(0.0)
        held = w.join(state.select("node_id", part.alias("part")), "node_id").groupBy("edge_id").agg(F.sum("part").alias("held"))
        got = w.join(held, "edge_id").groupBy("node_id").agg(F.sum(F.col("weight") * F.col("held")).alias("got"))
        new = state.join(got, "node_id", "left").withColumn("got", F.coalesce("got", F.lit(0.0)) - F.col("own") * part)
        new = cut(new.select("node_id", "out", "own", ((1 - damping) / n + damping * (F.col("got") + lost / n)).alias("rank"), F.col("rank").alias("old")))
        state = new.drop("old")
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) < tolerance:
            break
    return state.select("node_id", "rank")


def expand(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranks of supernodes, given to each of their nodes (node_id, rc)."""
    return nodes.join(ranks.withColumnRenamed("node_id", "rc"), "rc").select("node_id", "rank")


def bipartite_pagerank(inc: DataFrame, iterations: int, **options) -> DataFrame:
    """On the directed graph from nodes to hyperedges, whose hyperedges are sinks; ranks of the nodes. Even numbers stand for nodes, odd ones for hyperedges."""
    links = cut(inc.select(F.shiftleft("node_id", 1).alias("src"), (F.shiftleft("edge_id", 1) + 1).alias("dst"), F.lit(1).alias("w")))
    every = links.select(F.col("src").alias("node_id")).union(links.select("dst")).distinct()
    return pagerank(every, links, iterations, **options).filter("node_id % 2 = 0").select(F.shiftright("node_id", 1).alias("node_id"), "rank")


def diffusion(inc: DataFrame, weights: DataFrame, start: int, steps: int, **options) -> DataFrame:
    """(node_id, x) of diffusions() from one node."""
    seeds = inc.sparkSession.createDataFrame([(start,)], "node_id long")
    return diffusions(inc, weights, seeds, steps, **options).select("node_id", "x")


def diffusions(inc: DataFrame, weights: DataFrame, seeds: DataFrame, steps: int, teleport: float = 0.15, cutoff: float = 1e-5, tie: float = 1e-8, active_only: bool = True) -> DataFrame:
    """(seed, node_id, x) of the nonzero values after `steps` of personalized diffusion from each of seeds (node_id), all at once.

    In each step each active hyperedge moves its weight times the difference of its largest and smallest x / weighted
    degree, from all that tie for the largest to all that tie for the smallest. Values below the cutoff then become 0, and
    hyperedges of nodes that became nonzero active. active_only=False: all hyperedges are active from the start. Either
    way a hyperedge moves something only if one of its nodes is nonzero, and it is active then, so these are what is met.

    Hyperedges' lists are made once, from inc's rows, repeated or not; a row per seed, hyperedge and node is never written.
    """
    inc = inc.filter("edge_id is not null and node_id is not null").select("edge_id", "node_id").repartition("edge_id")
    lists = inc.groupBy("edge_id").agg(F.collect_set("node_id").alias("nodes"))
    lists = stored(lists.join(weights.filter("weight is not null").select("edge_id", "weight"), "edge_id"))
    wd = stored(lists.select("weight", F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.sum("weight").alias("wd")))
    homes = cut(seeds.select(F.col("node_id").alias("seed")).distinct())
    zero = F.lit(0.0)
    x = homes.select("seed", F.col("seed").alias("node_id"), F.lit(1.0).alias("x"))
    for _ in range(steps):
        y = x.join(wd, "node_id").select("seed", "node_id", (F.col("x") / F.col("wd")).alias("y"))
        moved = _flows(lists, y, tie).select("seed", "node_id", zero.alias("x"), "l")
        # A seed gets its teleport also when nothing moves to it.
        moved = moved.union(x.select("seed", "node_id", "x", zero.alias("l"))).union(homes.select("seed", F.col("seed").alias("node_id"), zero, zero))
        moved = moved.groupBy("seed", "node_id").agg(F.sum("x").alias("x"), F.sum("l").alias("l"))
        home = F.when(F.col("node_id") == F.col("seed"), 1.0).otherwise(0.0)
        new = F.col("x") - (1 - teleport) * F.col("l") - teleport * (F.col("x") - home)
        x = stored(moved.select("seed", "node_id", new.alias("x")).filter(F.col("x") >= cutoff))
    return x


def _flows(lists: DataFrame, y: DataFrame, tie: float) -> DataFrame:
    """(seed, node_id, l): what nodes give in the hyperedges lists (edge_id, weight, nodes) at the values y (seed, node_id, y), in parts to be summed.

    Seeds don't depend on each other: blocks of them, of about FEW values each, go to the tasks that read the lists. Where
    that takes over BLOCKS of them, or a block has over twice as many, values are joined with the lists' nodes instead.
    """
    y = stored(y)
    blocks = max(1, -(-y.count() // FEW))
    schema = "seed long, node_id long, l double"
    if blocks > BLOCKS:
        return _joined(lists, y).mapInArrow(lambda batches: _run(batches, None, tie), schema)
    y = y.withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    counts = {r["block"]: r["count"] for r in y.groupBy("block").count().collect()}
    large = [b for b, n in counts.items() if n > 2 * FEW]
    parts = [_joined(lists, y.filter(F.col("block").isin(large))).mapInArrow(lambda batches: _run(batches, None, tie), schema)] if large else []
    for b in counts.keys() - set(large):
        t = y.filter(F.col("block") == b).select("node_id", "seed", "y").toArrow()
        nodes, of, values = (t.column(i).to_numpy() for i in range(3))
        order = np.argsort(nodes, kind="stable")
        nodes, first = np.unique(nodes[order], return_index=True)
        held = y.sparkSession.sparkContext.broadcast((nodes, np.append(first, len(order)), of[order], values[order]))
        parts.append(lists.select("weight", "nodes").mapInArrow(lambda batches, held=held: _run(batches, held, tie), schema))
    return reduce(DataFrame.union, parts) if parts else y.select("seed", "node_id", F.col("y").alias("l"))


def _joined(lists: DataFrame, y: DataFrame) -> DataFrame:
    """(weight, nodes, seeds, ys): the lists with the seeds and values of each of their nodes."""
    of = y.groupBy("node_id").agg(F.collect_list(F.struct("seed", "y")).alias("of"))
    each = lists.select("edge_id", "weight", F.explode("nodes").alias("node_id")).join(of, "node_id", "left")
    each = each.repartition("edge_id").groupBy("edge_id").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("node_id", F.coalesce("of", F.array().cast("array<struct<seed:bigint,y:double>>")).alias("of"))).alias("m"))
    return each.select("weight", F.col("m.node_id").alias("nodes"), F.transform("m", lambda m: m["of"]["seed"]).alias("seeds"), F.transform("m", lambda m: m["of"]["y"]).alias("ys"))


def _run(batches: Iterator[pa.RecordBatch], held, tie: float) -> Iterator[pa.RecordBatch]:
    """_moves() of batches (weight, nodes) at the values of a broadcast, or of (weight, nodes, seeds, ys)."""
    ends = lambda a: np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        weight, first, nodes = batch.column(0).to_numpy(zero_copy_only=False).astype(float), ends(batch.column(1)), batch.column(1).flatten().to_numpy()
        if held is None:
            seeds, ys = batch.column(2).flatten(), batch.column(3).flatten()
            start = ends(seeds)
            found = _moves(weight, first, nodes, start[:-1], np.diff(start), seeds.flatten().to_numpy(), ys.flatten().to_numpy(), tie)
        else:
            known, start, seeds, ys = held.value
            at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
            found = _moves(weight, first, nodes, start[at], np.where(known[at] == nodes, start[at + 1] - start[at], 0), seeds, ys, tie)
        for s, v, l in found:  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(v), pa.array(l)], names=["seed", "node_id", "l"])


def _ranges(sizes: np.ndarray, each: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes sum to about `each`, or of one."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // each)) + 1
    return zip([0, *cuts], [*cuts, len(sizes)], strict=True)


def _moves(weight: np.ndarray, first: np.ndarray, nodes: np.ndarray, start: np.ndarray, n: np.ndarray, seeds: np.ndarray, ys: np.ndarray, tie: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays of seeds, nodes and what these give: hyperedge i has nodes[first[i]:first[i + 1]], of which j has the n[j] nonzero values ys[start[j]:] of seeds."""
    size, before = np.diff(first), np.concatenate([[0], np.cumsum(n)])
    edge = np.repeat(np.arange(len(size)), size)
    for a, b in _ranges(before[first[1:]] - before[first[:-1]]):
        j = np.repeat(np.arange(first[a], first[b]), n[first[a] : first[b]])
        if not len(j):
            continue
        at = start[j] + np.arange(len(j)) - (before[j] - before[first[a]])
        e, s, y = edge[j], seeds[at], ys[at]
        order = np.lexsort((s, e))
        j, e, s, y = j[order], e[order], s[order], y[order]
        # A group is a hyperedge and a seed; its other nodes are at 0.
        g0 = np.flatnonzero(np.concatenate([[True], (np.diff(e) != 0) | (np.diff(s) != 0)]))
        ge, gs, some = e[g0], s[g0], np.diff(np.append(g0, len(e)))
        q = size[ge]
        zeros, g = q - some, np.repeat(np.arange(len(g0)), some)
        hi, lo = np.maximum.reduceat(y, g0), np.minimum.reduceat(y, g0)
        hi, lo = np.where(zeros > 0, np.maximum(hi, 0), hi), np.where(zeros > 0, np.minimum(lo, 0), lo)
        top, low, top0, low0 = y > hi[g] - tie, y < lo[g] + tie, 0 > hi - tie, 0 < lo + tie
        tops, lows = np.add.reduceat(top.astype(np.int64), g0) + zeros * top0, np.add.reduceat(low.astype(np.int64), g0) + zeros * low0
        flow = weight[ge] * (hi - lo)
        given, given0 = flow[g] * (top / tops[g] - low / lows[g]), flow * (top0 / tops - low0 / lows)
        for c, d in _ranges(q):
            base = np.cumsum(q[c:d]) - q[c:d]
            i = np.repeat(first[ge[c:d]] - base, q[c:d]) + np.arange(q[c:d].sum())
            out, own = np.repeat(given0[c:d], q[c:d]), slice(g0[c], g0[d] if d < len(g0) else None)
            out[base[g[own] - c] + j[own] - first[e[own]]] = given[own]
            k = np.flatnonzero(out)
            yield np.repeat(gs[c:d], q[c:d])[k], nodes[i[k]], out[k]


def personalized_in_summary(superinc: DataFrame, weights: DataFrame, nodes: DataFrame, seeds: DataFrame, steps: int, **options) -> DataFrame:
    """(seed, node_id, x): diffusions() on a summary from the supernodes of seeds; each node has its supernode's value. nodes (node_id, rc)."""
    homes = nodes.join(seeds.select("node_id"), "node_id").select(F.col("node_id").alias("seed"), "rc")
    x = diffusions(superinc, weights, homes.select(F.col("rc").alias("node_id")).distinct(), steps, **options)
    x = homes.join(x.select(F.col("seed").alias("rc"), F.col("node_id").alias("to"), "x"), "rc")
    return x.join(nodes.withColumnRenamed("rc", "to"), "to").select("seed", "node_id", "x")
