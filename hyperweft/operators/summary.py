"""Lossless summaries: block counts, superedges, corrections, decoding and costs.

Inputs are an incidence, node clusters (node_id, rc) and edge clusters (edge_id, cc). A superedge is the set of the node
clusters of which a block with its edge cluster is at least half full; identical ones are one, named by the smallest cc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import as_list


def block_counts(inc: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rc, cc, dnz, nx, ny, selected) of the nonzero blocks; selected: 2 dnz >= nx ny."""
    d = inc.join(nodes, "node_id").join(edges, "edge_id").groupBy("rc", "cc").agg(F.count(F.lit(1)).alias("dnz"))
    return _sized(d, nodes, edges)


def _sized(d: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    nx, ny = nodes.groupBy("rc").agg(F.count(F.lit(1)).alias("nx")), edges.groupBy("cc").agg(F.count(F.lit(1)).alias("ny"))
    return d.join(nx, "rc").join(ny, "cc").select("rc", "cc", "dnz", "nx", "ny", (2 * F.col("dnz") >= F.col("nx") * F.col("ny")).alias("selected"))


def block_merge(blocks: DataFrame, nodes: DataFrame, edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Blocks after edge clusters merge by merged (cc, new_cc); counts are added, not counted again."""
    d = blocks.join(merged, "cc").groupBy("rc", F.col("new_cc").alias("cc")).agg(F.sum("dnz").alias("dnz"))
    return _sized(d, nodes, edges.join(merged, "cc").select("edge_id", F.col("new_cc").alias("cc")))


def original_cost(inc: DataFrame) -> DataFrame:
    return inc.agg((F.count_distinct("edge_id") + F.count(F.lit(1))).alias("cost"))


def num_corrections(blocks: DataFrame) -> DataFrame:
    b = F.when(F.col("selected"), F.col("nx") * F.col("ny") - F.col("dnz")).otherwise(F.col("dnz"))
    return blocks.agg(F.coalesce(F.sum(b), F.lit(0)).alias("corrections"))


def matrix_cost(blocks: DataFrame, edges: DataFrame, weights: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Edge clusters, selected blocks and corrections, weighted: the cost before identical superedges are one."""
    k = edges.agg(F.count_distinct("cc").alias("k"))
    s = blocks.agg(F.count(F.when(F.col("selected"), 1)).alias("s")).join(F.broadcast(num_corrections(blocks))).join(F.broadcast(k))
    return s.select((weights[0] * F.col("k") + weights[1] * F.col("s") + weights[2] * F.col("corrections")).cast("long").alias("cost"))


def superedges(blocks: DataFrame) -> DataFrame:
    """(se_id, sn_id) before consolidation: the selected blocks."""
    return blocks.filter("selected").select(F.col("cc").alias("se_id"), F.col("rc").alias("sn_id"))


def edge_to_superedge(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(cc, members, ny, se_id): each edge cluster's superedge, empty ones included; se_id is the smallest cc with the same members."""
    members = superedges(blocks).groupBy(F.col("se_id").alias("cc")).agg(as_list(F.collect_list("sn_id")).alias("members"))
    ny = edges.groupBy("cc").agg(F.count(F.lit(1)).alias("ny"))
    each = ny.join(members, "cc", "left").withColumn("members", F.coalesce("members", F.lit("")))
    return each.join(each.groupBy("members").agg(F.min("cc").alias("se_id")), "members")


def consolidated(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(se_id, members, weight): identical superedges as one, their hyperedges counted."""
    return edge_to_superedge(blocks, edges).groupBy("se_id", "members").agg(F.sum("ny").alias("weight"))


def as_hypergraph(blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidence, weights) of the summary itself: supernodes as nodes, its different nonempty superedges as hyperedges, weighted by the hyperedges that they stand for."""
    c = consolidated(blocks, edges).filter("members <> ''")
    inc = c.select(F.col("se_id").alias("edge_id"), F.explode(F.split("members", ",").cast("array<long>")).alias("node_id"))
    return inc, c.select(F.col("se_id").alias("edge_id"), "weight")


def longest_first(lists: DataFrame, members: str = "members", sep: str = ",") -> DataFrame:
    """lists with position: longer ones first, then by text."""
    size = F.when(F.col(members) == "", 0).otherwise(F.size(F.split(members, sep)))
    from .relational import positions

    return positions(lists.withColumn("size", size), [F.desc("size"), F.col(members)]).drop("size")


def templates(blocks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, node_id) that the summary gives without corrections."""
    return edges.join(superedges(blocks).withColumnRenamed("se_id", "cc"), "cc").join(nodes.withColumnRenamed("rc", "sn_id"), "sn_id").select("edge_id", "node_id")


def corrections(inc: DataFrame, blocks: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plus, minus), each (edge_id, node_id): what a hyperedge has beyond its template, and lacks of it."""
    t = templates(blocks, nodes, edges)
    return inc.select("edge_id", "node_id").join(t, ["edge_id", "node_id"], "left_anti"), t.join(inc, ["edge_id", "node_id"], "left_anti")


def corrections_per_edge(plus: DataFrame, minus: DataFrame) -> DataFrame:
    """(edge_id, n_plus, n_minus) of hyperedges that need corrections."""
    both = plus.select("edge_id", F.lit(1).alias("p"), F.lit(0).alias("m")).union(minus.select("edge_id", F.lit(0), F.lit(1)))
    return both.groupBy("edge_id").agg(F.sum("p").alias("n_plus"), F.sum("m").alias("n_minus"))


def decode(blocks: DataFrame, nodes: DataFrame, edges: DataFrame, plus: DataFrame, minus: DataFrame) -> DataFrame:
    """(edge_id, node_id): templates without minus, with plus."""
    return templates(blocks, nodes, edges).join(minus, ["edge_id", "node_id"], "left_anti").union(plus.select("edge_id", "node_id"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of memberships that only one of two incidences has, repeats counted."""
    x, y = a.select("edge_id", "node_id"), b.select("edge_id", "node_id")
    return x.exceptAll(y).union(y.exceptAll(x)).agg(F.count(F.lit(1)).alias("mismatches"))


def summary_cost(blocks: DataFrame, edges: DataFrame, plus: DataFrame, minus: DataFrame, weighted: DataFrame | None = None) -> DataFrame:
    """One row: superedges, their members, corrections and the values of correction weights (weighted: (weight) of the
    corrections that have one), and cost, the sum."""
    c = consolidated(blocks, edges)
    size = F.when(F.col("members") == "", 0).otherwise(F.size(F.split("members", ",")))
    c = c.agg(F.count(F.lit(1)).alias("superedges"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("members"))
    n = plus.select(F.lit(1).alias("x")).union(minus.select(F.lit(1))).agg(F.count(F.lit(1)).alias("corrections"))
    w = (weighted.filter("weight > 1") if weighted is not None else n.filter("false").select(F.lit(0).alias("weight"))).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weights"))
    row = c.join(F.broadcast(n)).join(F.broadcast(w))
    return row.withColumn("cost", F.col("superedges") + F.col("members") + F.col("corrections") + F.col("weights"))


def evaluate(inc: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: cluster numbers, cost and original cost of the summary."""
    blocks = block_counts(inc, nodes, edges)
    cost = summary_cost(blocks, edges, *corrections(inc, blocks, nodes, edges)).select("cost")
    k = nodes.agg(F.count_distinct("rc").alias("node_clusters")).join(F.broadcast(edges.agg(F.count_distinct("cc").alias("edge_clusters"))))
    return k.join(F.broadcast(cost)).join(F.broadcast(original_cost(inc).withColumnRenamed("cost", "original_cost")))


def correction_distribution(inc: DataFrame, plus: DataFrame, minus: DataFrame, cost: DataFrame) -> DataFrame:
    """One row: corrections by sign, and their shares of the original cost and of the summary's."""
    p, m = plus.agg(F.count(F.lit(1)).alias("n_plus")), minus.agg(F.count(F.lit(1)).alias("n_minus"))
    row = p.join(F.broadcast(m)).join(F.broadcast(original_cost(inc).withColumnRenamed("cost", "original"))).join(F.broadcast(cost.select("cost")))
    share = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return row.select("n_plus", "n_minus", *[share(a, b).alias(f"{a[2:]}_of_{c}") for a in ("n_plus", "n_minus") for b, c in (("original", "original"), ("cost", "summary"))])


def hyperdegree_in_summary(nodes: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Node's value: the weights of the superedges that hold its cluster, 0 if none does."""
    w = superedges(blocks).join(edges.groupBy(F.col("cc").alias("se_id")).agg(F.count(F.lit(1)).alias("ny")), "se_id").groupBy(F.col("sn_id").alias("rc")).agg(F.sum("ny").alias("value"))
    return nodes.join(w, "rc", "left").select("node_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def degree_in_summary(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Node's value: nodes of the clusters in superedges with its own, less itself; 0 if its cluster is in none."""
    s, sizes = superedges(blocks), nodes.groupBy(F.col("rc").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    pairs = s.join(s.withColumnRenamed("sn_id", "other"), "se_id").select(F.col("sn_id").alias("rc"), "other").distinct()
    v = pairs.join(sizes, "other").groupBy("rc").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("value"))
    return nodes.join(v, "rc", "left").select("node_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def edge_clusters_from_decoded(inc: DataFrame, decoded: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, cc): clusters of decoded hyperedges found for the original ones by their node sets; of equal sets the nth goes to the nth."""
    from pyspark.sql import Window

    def numbered(x: DataFrame) -> DataFrame:
        lists = x.groupBy("edge_id").agg(as_list(F.collect_list("node_id")).alias("members"))
        return lists.withColumn("nth", F.row_number().over(Window.partitionBy("members").orderBy("edge_id")))

    found = numbered(decoded).join(edges, "edge_id").drop("edge_id")
    return numbered(inc).join(found, ["members", "nth"]).select("edge_id", "cc")
