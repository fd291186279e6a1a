"""Representations and projections of a hypergraph, samples, statistics; all built-in DataFrame operations.

An incidence is (edge_id, node_id), a row per membership; weights are (edge_id, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_multiplicity(members: DataFrame) -> DataFrame:
    """(edge_id, node_id, mult) of memberships that may repeat."""
    return members.groupBy("edge_id", "node_id").agg(F.count(F.lit(1)).alias("mult"))


def as_list(nodes: Column) -> Column:
    """Ids, sorted as numbers, as a comma-separated string."""
    return F.array_join(F.transform(F.array_sort(nodes), lambda x: x.cast("string")), ",")


def hyperedge_lists(inc: DataFrame) -> DataFrame:
    return inc.groupBy(F.col("edge_id").alias("id")).agg(as_list(F.collect_list("node_id")).alias("members"), F.count(F.lit(1)).alias("size"))


def node_incidence_lists(inc: DataFrame) -> DataFrame:
    return inc.groupBy(F.col("node_id").alias("id")).agg(as_list(F.collect_set("edge_id")).alias("members"), F.count_distinct("edge_id").alias("size"))


def clique_projection(inc: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(src, dst, w), src < dst: nodes that share hyperedges, with the sum of these hyperedges' weights (1 each by default)."""
    a = inc if weights is None else inc.join(weights, "edge_id")
    a = a.select("edge_id", F.col("node_id").alias("src"), (F.lit(1) if weights is None else F.col("weight")).cast("long").alias("w"))
    b = inc.select("edge_id", F.col("node_id").alias("dst"))
    return a.join(b, "edge_id").filter("src < dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def bipartite_projection(inc: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): node -> number of nodes + hyperedge."""
    n = inc.agg(F.count_distinct("node_id").alias("n"))
    e = inc if weights is None else inc.join(weights, "edge_id")
    return e.join(F.broadcast(n)).select(F.col("node_id").alias("src"), (F.col("n") + F.col("edge_id")).alias("dst"), (F.lit(1) if weights is None else F.col("weight")).cast("long").alias("w"))


def line_graph(inc: DataFrame) -> DataFrame:
    """(e1, e2), e1 < e2: hyperedges that share a node."""
    a, b = inc.select("node_id", F.col("edge_id").alias("e1")), inc.select("node_id", F.col("edge_id").alias("e2"))
    return a.join(b, "node_id").filter("e1 < e2").select("e1", "e2").distinct()


def hypergraph_stats(inc: DataFrame) -> DataFrame:
    """One row: n, m and least, mean and most of hyperedge sizes and node degrees (hyperedges per node)."""

    def of(key: str, name: str, total: str) -> DataFrame:
        s = inc.groupBy(key).agg(F.count(F.lit(1)).alias("s"))
        return s.agg(F.count(F.lit(1)).alias(total), F.min("s").alias(f"min_{name}"), F.round(F.avg("s"), 3).alias(f"mean_{name}"), F.max("s").alias(f"max_{name}"))

    return of("node_id", "degree", "n").join(F.broadcast(of("edge_id", "size", "m"))).select("n", "m", "min_size", "mean_size", "max_size", "min_degree", "mean_degree", "max_degree")


def hyperdegree(inc: DataFrame) -> DataFrame:
    return inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("value"))


def weighted_degree(inc: DataFrame, weights: DataFrame) -> DataFrame:
    return inc.join(weights, "edge_id").groupBy("node_id").agg(F.sum("weight").alias("value"))


def degree(inc: DataFrame) -> DataFrame:
    """Number of other nodes that share a hyperedge; 0 for nodes in hyperedges of their own only."""
    other = inc.select("edge_id", F.col("node_id").alias("other"))
    pairs = inc.join(other, "edge_id").select("node_id", "other").distinct()
    return pairs.groupBy("node_id").agg((F.count(F.lit(1)) - 1).alias("value"))


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with a number from 0 by `order`: rows are sorted in ranges, and counted within them after those before. No task has all rows."""
    from ..plans.lineage import cut

    part = F.shiftright("seq", 33)
    d = cut(df.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()))
    counts = d.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row per range
    counts = counts.withColumn("before", F.sum("c").over(up) - F.col("c")).drop("c")
    d = d.withColumn("part", part).join(F.broadcast(counts), "part")
    # Ids count on within a range.
    return d.withColumn(name, (F.col("seq") - F.shiftleft("part", 33) + F.col("before")).cast("long")).drop("seq", "part", "before")


def cumulative(df: DataFrame, group: list[str], order: str, value: str, name: str = "total") -> DataFrame:
    """df with the running sum of a value by group and order; equal places count one by one, by value."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(order, value).rowsBetween(Window.unboundedPreceding, 0)))


def with_isolated(nodes: DataFrame, inc: DataFrame) -> DataFrame:
    """(node_id, isolated): all nodes of both, and whether no hyperedge has them."""
    members = inc.select("node_id").distinct().withColumn("isolated", F.lit(False))
    return members.union(nodes.select("node_id").distinct().join(inc, "node_id", "left_anti").withColumn("isolated", F.lit(True)))


def dedup_weighted(inc: DataFrame, weights: DataFrame) -> DataFrame:
    """Equal hyperedges merged: (members, weight, copies), weights summed."""
    lists = inc.groupBy("edge_id").agg(as_list(F.collect_list("node_id")).alias("members"))
    return lists.join(weights, "edge_id").groupBy("members").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("copies"))


def scrambled(key: Column, seed: int = 0) -> Column:
    """An arithmetic hash of an id that every SQL engine can compute; it orders samples."""
    return ((key + seed) * 2654435761) % 4294967296


#: Fixed value: a prime, the range of linear hashes.
PRIME = 2147483647


def linear_terms(n: int) -> tuple[int, int]:
    """Factor and summand of the nth linear hash."""
    return n * 2654435761 % (PRIME - 1) + 1, (n * 40503 + 12345) * 69069 % PRIME


def linear_hash(key: Column, factor: Column, summand: Column) -> Column:
    """A whole number below PRIME from an id, that any SQL engine can compute without overflow."""
    return ((key % PRIME) * factor + summand) % PRIME


def nested_sample(inc: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The incidence of the first ceil(fraction * m), at least one, hyperedges of a fixed permutation: a larger fraction holds a smaller one.

    The hash of the last hyperedge taken is found by exact selection over (hash, id), so no task orders all hyperedges.
    """
    edges = inc.select("edge_id").distinct().withColumn("h", scrambled(F.col("edge_id"), seed))
    m = edges.count()
    take = max(1, -(-m * round(fraction * 1000) // 1000)) if m else 0
    return inc.join(_first(edges, "edge_id", take), "edge_id", "left_semi")


def sample_nodes(inc: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes (without replacement, unlike a draw with it) by the order of their hash."""
    nodes = inc.select("node_id").distinct().withColumn("h", scrambled(F.col("node_id"), seed))
    return nodes.orderBy("h", "node_id").limit(k).select("node_id")


def _first(df: DataFrame, key: str, take: int) -> DataFrame:
    """The `take` smallest rows by (h, key): hashes are counted in 4096 ranges, and only the range of the last one is ranked."""
    ranged = df.withColumn("range", F.floor(F.col("h") / 1048576))
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(up) - F.col("c"))
    ranged = ranged.join(F.broadcast(counts), "range").filter(F.col("before") < take)
    nth = F.row_number().over(Window.partitionBy("range").orderBy("h", key)) + F.col("before")
    return ranged.withColumn("nth", nth).filter(F.col("nth") <= take).select(key)


def drop_empty(inc: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (edge_id, ...) and nodes (node_id, ...) that have memberships."""
    return edges.join(inc, "edge_id", "left_semi"), nodes.join(inc, "node_id", "left_semi")


def binary(values: DataFrame) -> DataFrame:
    """An incidence from (edge_id, node_id, value): nonzero entries; a value that isn't finite is an error."""
    fine = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), F.raise_error(F.lit("values must be finite"))).otherwise(F.col("value"))
    return values.withColumn("value", fine).filter("value <> 0").select("edge_id", "node_id").distinct()


def first_seen_labels(labelled: DataFrame, order: str, label: str) -> DataFrame:
    """labelled with new_label: labels numbered from 0 in the order in which they first occur."""
    firsts = labelled.groupBy(label).agg(F.min(order).alias("first"))
    firsts = positions(firsts, [F.col("first"), F.col(label)], "new_label")
    return labelled.join(firsts.drop("first"), label)


def cluster_permutation(labelled: DataFrame, key: str, label: str) -> DataFrame:
    """labelled with position: rows by cluster, within it by key; counted within clusters, plus the sizes of those before."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    up = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("before", F.sum("c").over(up) - F.col("c")).drop("c")
    nth = F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1
    return labelled.withColumn("nth", nth).join(sizes, label).withColumn("position", (F.col("nth") + F.col("before")).cast("long")).drop("nth", "before")
