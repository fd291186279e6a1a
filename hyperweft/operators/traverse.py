"""Breadth-first searches, k-hop neighbourhoods, components and closeness, as joins of a frontier with the incidence.

Nodes at distance d + 1 share a hyperedge with one at distance d, so the incidence itself is searched; the line graph is
never made. All sources are searched at once. On a summary, the incidence is that of superedges over supernodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored
from .relational import positions


#: Sources that a row of a search stands for, a bit each.
WORD = 64
#: Tables of sources of up to so many rows are broadcast; nodes of a chunk.
FEW, CHUNK = 1_000_000, 1024
#: Fixed values of searches from all nodes: entries of a component that a task holds, of a part of small components, and of
#: a step of a search; words that a task searches at once; bytes of packed parts that a task has about.
HELD, SMALL, STEP, WORDS, BYTES = 8_000_000, 4096, 32_768, 16, 1 << 24


def bfs(inc: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(src, node, dist) of all nodes that sources (node_id) reach, themselves at 0.

    Sources are searched in words of 64: a row is a node and the bits of the sources that have reached it, so each hop
    goes over the incidence once a word. Nodes' and hyperedges' lists are made once.
    """
    inc = inc.filter("edge_id is not null and node_id is not null")
    edges_of = stored(inc.groupBy("node_id").agg(F.collect_set("edge_id").alias("edges")))
    nodes_of = stored(inc.groupBy("edge_id").agg(F.collect_set("node_id").alias("nodes")))
    numbered = cut(positions(sources.select(F.col("node_id").alias("src")).distinct(), [F.col("src")], "nth"))
    bit = F.expr(f"shiftleft(1L, cast(nth % {WORD} as int))")
    merged = lambda x, key: x.groupBy("word", key).agg(F.bit_or("bits").alias("bits"))
    seen = cut(numbered.select(F.floor(F.col("nth") / WORD).alias("word"), F.col("src").alias("node_id"), bit.alias("bits")))
    seen = merged(seen, "node_id").withColumn("dist", F.lit(0).cast("long"))
    frontier, hop = seen, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        edges = merged(frontier.join(edges_of, "node_id").select("word", F.explode("edges").alias("edge_id"), "bits"), "edge_id")
        new = merged(edges.join(nodes_of, "edge_id").select("word", F.explode("nodes").alias("node_id"), "bits"), "node_id")
        new = new.join(merged(seen, "node_id").withColumnRenamed("bits", "old"), ["word", "node_id"], "left")
        new = new.select("word", "node_id", F.expr("bits & ~coalesce(old, 0L)").alias("bits"), F.lit(hop).cast("long").alias("dist"))
        frontier = cut(new.filter("bits <> 0"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    numbered = F.broadcast(numbered) if numbered.count() <= FEW else numbered
    each = seen.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(WORD)]))).filter("shiftright(bits, i) & 1 = 1")
    return each.select((F.col("word") * WORD + F.col("i")).alias("nth"), F.col("node_id").alias("node"), "dist").join(numbered, "nth").select("src", "node", "dist")


def _packed(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of at most HELD entries as rows (ids, sizes, members, low, high), and the incidence of the larger ones.

    ids are a part's nodes, sizes its hyperedges' numbers of members, and members these as places in ids, in bytes; a part
    is a component, or some small ones. Its sources are dealt over rows in ranges of words, from low to below high.
    """
    comps = connected_components(inc).withColumnRenamed("comp", "c")
    inc = stored(inc.join(comps, "node_id"))
    size = cut(inc.groupBy("c").agg(F.count(F.lit(1)).alias("z"), F.count_distinct("node_id").alias("n")))
    small = size.filter(f"z <= {SMALL}").agg(F.coalesce(F.sum("z"), F.lit(0))).first()[0]
    own = F.when(F.col("z") <= SMALL, F.pmod(F.xxhash64("c"), F.lit(1 + small // SMALL))).otherwise(F.col("c"))
    parts = size.filter(f"z <= {HELD}").select("c", (F.col("z") <= SMALL).alias("some"), own.alias("part"), "z", "n")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf["node_id"].to_numpy(), return_inverse=True)
        order = np.argsort(pdf["edge_id"].to_numpy(), kind="stable")
        edges = pdf["edge_id"].to_numpy()[order]
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, edges[1:] != edges[:-1])), len(edges)))
        packed = [x.astype(t).tobytes() for x, t in ((ids, "int64"), (sizes, "int32"), (at[order], "int32"))]
        return pd.DataFrame([(*packed, -(-len(ids) // WORD), len(ids) * len(at) / 1e6)], columns=["ids", "sizes", "members", "words", "work"])

    held = inc.join(parts.select("c", "some", "part"), "c").select("some", "part", F.col("edge_id").cast("long"), F.col("node_id").cast("long"))
    held = cut(held.groupBy("some", "part").applyInPandas(pack, "ids binary, sizes binary, members binary, words long, work double"))
    tasks = 4 * inc.sparkSession.sparkContext.defaultParallelism
    share = (held.agg(F.sum("work")).first()[0] or 0.0) / tasks
    # Ranges of about the same work; a part with little of it is one row.
    each = F.greatest(F.lit(1), F.floor(F.col("words") * share / F.greatest("work", F.lit(1e-6)))).cast("long")
    held = held.withColumn("each", each).withColumn("low", F.explode(F.expr("sequence(0L, words - 1, each)")))
    held = held.select("ids", "sizes", "members", "low", F.least(F.col("low") + F.col("each"), "words").alias("high"))
    # Tasks are so many that their batches stay small.
    whole = held.agg(F.sum(F.octet_length("ids") + F.octet_length("sizes") + F.octet_length("members"))).first()[0] or 0
    return held.repartition(max(tasks, whole // BYTES), F.xxhash64("ids"), "low"), inc.join(size.filter(f"z > {HELD}"), "c").select("edge_id", "node_id")


def _ored(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each list of places, of these sizes one after the other, the bits of its rows, in steps of STEP places."""
    out, of = np.zeros((len(sizes), rows.shape[1]), "uint64"), np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(at), STEP):
        first = np.flatnonzero(np.diff(of[i : i + STEP], prepend=-1))
        out[of[i : i + STEP][first]] |= np.bitwise_or.reduceat(rows[at[i : i + STEP]], first, axis=0)
    return out


def _searched(batch: pa.RecordBatch, hops: int | None) -> Iterator[tuple[np.ndarray, int, Iterator[tuple[int, np.ndarray]]]]:
    """Of each row of _packed(), for some words at a time: ids, the first source's place, and by distance the sources' bits at each node."""

    def levels(members, sizes, edges, degrees, low, high, n):
        new = np.zeros((n, high - low), "uint64")
        at = np.arange(low * WORD, min(high * WORD, n))
        new[at, at // WORD - low] = np.uint64(1) << (at % WORD).astype("uint64")
        seen, hop = new.copy(), 0
        yield 0, new
        while hops is None or hop < hops:
            hop += 1
            new = _ored(_ored(new, members, sizes), edges, degrees) & ~seen
            if not new.any():
                return
            seen |= new
            yield hop, new

    for row in batch.to_pylist():
        ids, sizes, members = (np.frombuffer(row[x], t) for x, t in (("ids", "int64"), ("sizes", "int32"), ("members", "int32")))
        edges = np.repeat(np.arange(len(sizes), dtype="int32"), sizes)[np.argsort(members, kind="stable")]
        degrees = np.bincount(members, minlength=len(ids))
        for low in range(row["low"], row["high"], WORDS):
            yield ids, low * WORD, levels(members, sizes, edges, degrees, low, min(low + WORDS, row["high"]), len(ids))


def khop_of_all(inc: DataFrame, k: int) -> DataFrame:
    """khop() of all nodes: (src, neigh), component by component; tasks hold a component and search ranges of its nodes as bits."""
    inc = inc.filter("edge_id is not null and node_id is not null")
    held, rest = _packed(inc)
    k = max(1, k)

    def pairs(batches):
        for batch in batches:
            for ids, first, levels in _searched(batch, k):
                # Bits of all distances but 0.
                near = sum((new for hop, new in levels if hop), np.uint64(0))
                if not np.ndim(near):
                    continue
                step = max(1, 1_000_000 // (near.shape[1] * WORD))
                for i in range(0, len(ids), step):
                    bits = np.unpackbits(near[i : i + step].astype("<u8").view("uint8"), axis=1, bitorder="little")
                    to, src = np.nonzero(bits)
                    if len(to):
                        yield pa.RecordBatch.from_pydict({"src": ids[first + src], "neigh": ids[i + to]})

    out = held.mapInArrow(pairs, "src long, neigh long")
    return out if rest.isEmpty() else out.union(khop(rest, rest.select("node_id").distinct(), k))


def closeness_of_all(inc: DataFrame, n: int) -> DataFrame:
    """closeness() of all nodes. Distances are the same both ways, so a node's are counted by the sources that reach it: no pair is a row."""
    inc = inc.filter("edge_id is not null and node_id is not null")
    held, rest = _packed(inc)

    def sums(batches):
        for batch in batches:
            for ids, _, levels in _searched(batch, None):
                far, met = np.zeros(len(ids), "int64"), np.zeros(len(ids), "int64")
                for hop, new in levels:
                    count = np.bitwise_count(new).sum(axis=1, dtype="int64")
                    far, met = far + hop * count, met + count
                yield pa.RecordBatch.from_pydict({"node_id": ids, "far": far, "met": met})

    d = held.mapInArrow(sums, "node_id long, far long, met long").groupBy("node_id").agg(F.sum("far").alias("dist_sum"), (F.sum("met") - 1).alias("reached"))
    d = d.withColumn("closeness", F.when(F.col("dist_sum") > 0, F.round((n - 1) / F.col("dist_sum"), 6)).otherwise(0.0))
    return d if rest.isEmpty() else d.union(closeness(rest, rest.select("node_id").distinct(), n))


def reachability(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with dist: 0 if equal, checked first; -1 if b isn't reached or either is unknown (null)."""
    found = bfs(inc, pairs.filter("a is not null").select(F.col("a").alias("node_id")).distinct())
    found = found.select(F.col("src").alias("a"), F.col("node").alias("b"), "dist")
    dist = F.when(F.coalesce(F.col("a"), F.lit(-1)) == F.coalesce(F.col("b"), F.lit(-1)), 0).otherwise(F.coalesce("dist", F.lit(-1))).cast("long")
    return pairs.join(found, ["a", "b"], "left").withColumn("dist", dist)


def reachability_in_summary(superinc: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the distance of their supernodes; nodes (node_id, rc). Two unknown nodes are at 0, like two of one supernode."""
    side = lambda c, x: nodes.select(F.col("node_id").alias(c), F.col("rc").alias(x))
    mapped = pairs.join(side("a", "sa"), "a", "left").join(side("b", "sb"), "b", "left").fillna(-1, ["sa", "sb"])
    sn = reachability(superinc, mapped.select(F.col("sa").alias("a"), F.col("sb").alias("b")).distinct())
    return mapped.join(sn.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "dist"), ["sa", "sb"]).select("a", "b", "dist")


def khop(inc: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(src, neigh) of nodes at distance 1 to k; k below 1 counts as 1."""
    return bfs(inc, sources, max(1, k)).filter("node <> src").select("src", F.col("node").alias("neigh"))


def khop_in_summary(superinc: DataFrame, nodes: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(src, neigh): members of the supernodes within k hops of the source's; those of its own supernode are left out."""
    superinc, nodes = cut(superinc.select("edge_id", "node_id")), cut(nodes.select("node_id", "rc"))
    mapped = sources.join(nodes, "node_id").select(F.col("node_id").alias("src"), "rc")
    hops = khop(superinc, mapped.select(F.col("rc").alias("node_id")).distinct(), k).select(F.col("src").alias("rc"), F.col("neigh").alias("to"))
    # Members go in chunks, so that a pair of a source and a supernode is spread over tasks however large the latter is.
    parts = nodes.groupBy(F.col("rc").alias("to")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    chunk = F.pmod(F.xxhash64("node_id"), "parts").alias("chunk")
    members = nodes.withColumnRenamed("rc", "to").join(parts, "to").groupBy("to", chunk).agg(F.collect_list("node_id").alias("members"))
    pairs = mapped.join(hops.join(parts, "to"), "rc").select("src", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"))
    tasks = 4 * superinc.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(tasks, "to", "chunk").join(members, ["to", "chunk"]).select("src", F.explode("members").alias("neigh"))


def connected_components(inc: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, comp): comp is the component's smallest node. nodes: also those without hyperedges, each its own.

    Each hyperedge links its members to its smallest one; links then contract by alternating large and small stars, in
    which nodes of many links are never met in pairs, until nothing changes.
    """
    every = inc.select("node_id").distinct() if nodes is None else nodes.select("node_id").union(inc.select("node_id")).distinct()
    least = inc.groupBy("edge_id").agg(F.min("node_id").alias("b"))
    links = inc.join(least, "edge_id").select(F.col("node_id").alias("a"), "b").filter("a <> b").distinct()
    links, seen = cut(links), None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        # Two 64-bit sums of hashes tell whether anything changed.
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen:
            break
        seen = mark
    return every.join(links.withColumnRenamed("a", "node_id"), "node_id", "left").select("node_id", F.coalesce("b", "node_id").alias("comp"))


def closeness(inc: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """(node_id, dist_sum, reached, closeness) = (n - 1) / sum of distances to reachable nodes; 0 if there are none. n: all nodes, isolated ones too."""
    d = bfs(inc, sources).groupBy(F.col("src").alias("node_id")).agg(F.sum("dist").alias("dist_sum"), (F.count(F.lit(1)) - 1).alias("reached"))
    return d.withColumn("closeness", F.when(F.col("dist_sum") > 0, F.round((n - 1) / F.col("dist_sum"), 6)).otherwise(0.0))


def closeness_in_summary(superinc: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """As closeness(), of the nodes' supernodes among all supernodes."""
    k = nodes.select("rc").distinct().count()
    mapped = sources.join(nodes, "node_id")
    c = closeness(superinc, mapped.select(F.col("rc").alias("node_id")).distinct(), k).withColumnRenamed("node_id", "rc")
    return mapped.join(c, "rc").select("node_id", "dist_sum", "reached", "closeness")
