"""Weights, co-clustering measures, code lengths, pair statistics and neighbour hypergraphs; built-in operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy_bits, log_star_column
from ..plans.lineage import cut, stored


#: Fixed value: tables of pairs of up to so many rows are broadcast.
PAIR_ROWS = 500_000
#: Up to so many hyperedges, members that two share are counted in a matrix; products that cost as much as a row of a join.
EDGES, PRODUCTS = 1024, 200


def _dots_by_nodes(inc: DataFrame) -> DataFrame:
    """(edge_id, node_id, dot): hyperedges that a member shares with each member, itself too, summed; by pairs of members."""
    a, b = inc.select("edge_id", "node_id"), inc.select("edge_id", F.col("node_id").alias("other"))
    # Hyperedges that two nodes share, for each pair of members.
    x, y = inc.select("edge_id", "node_id"), inc.select("edge_id", F.col("node_id").alias("other"))
    shared = x.join(y, "edge_id").groupBy("node_id", "other").agg(F.count(F.lit(1)).alias("both"))
    return a.join(b, "edge_id").join(shared, ["node_id", "other"]).groupBy("edge_id", "node_id").agg(F.sum("both").alias("dot"))


def _dots_by_edges(inc: DataFrame) -> DataFrame:
    """As _dots_by_nodes(), by pairs of a node's hyperedges: the members that a hyperedge shares with each of the node's, summed."""
    a, b = inc.select("edge_id", "node_id"), inc.select("node_id", F.col("edge_id").alias("other"))
    shared = cut(a.join(b, "node_id").groupBy("edge_id", "other").agg(F.count(F.lit(1)).alias("both")))
    shared = F.broadcast(shared) if shared.count() <= PAIR_ROWS else shared
    return a.join(b, "node_id").join(shared, ["edge_id", "other"]).groupBy("edge_id", "node_id").agg(F.sum("both").alias("dot"))


def _dots_by_matrix(inc: DataFrame) -> DataFrame:
    """As _dots_by_nodes(), by matrix products over nodes' lists of hyperedges, whose ids are long; whole numbers below 2^53, so exact."""
    import numpy as np
    import pyarrow as pa

    edges = np.array(sorted(r[0] for r in inc.select("edge_id").distinct().collect()), "int64")
    lists = stored(inc.groupBy("node_id").agg(F.collect_list("edge_id").alias("edges")))

    def blocks(batches):
        """Nodes, their rows and places of hyperedges, and the incidence as a matrix, of 2048 nodes at a time."""
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                n = some.column("edges").value_lengths().to_numpy(zero_copy_only=False)
                row, at = np.repeat(np.arange(len(n)), n), np.searchsorted(edges, some.column("edges").flatten().to_numpy())
                x = np.zeros((len(n), len(edges)))
                np.add.at(x, (row, at), 1)
                yield some.column("node_id").to_numpy(), row, at, x

    def count(batches):
        both = np.zeros((len(edges), len(edges)))
        for _, _, _, x in blocks(batches):
            both += x.T @ x
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "both": both[a, b].astype("int64")})

    shared = np.zeros((len(edges), len(edges)))
    for r in lists.mapInArrow(count, "a long, b long, both long").groupBy("a", "b").agg(F.sum("both")).collect():
        shared[r[0], r[1]] = r[2]
    held = inc.sparkSession.sparkContext.broadcast(shared)

    def dot(batches):
        for ids, row, at, x in blocks(batches):
            yield pa.RecordBatch.from_pydict({"edge_id": edges[at], "node_id": ids[row], "dot": (x @ held.value)[row, at].astype("int64")})

    return lists.mapInArrow(dot, "edge_id long, node_id long, dot long")


def edge_distances(inc: DataFrame) -> DataFrame:
    """(edge_id, node_id, q, dist): squared distance of a member's incidence row to the mean of the other members' rows.

    With s the sum of all members' rows and q their number: (q^2 |x|^2 - 2 q x.s + |s|^2) / (q - 1)^2, at least 0. All but
    the division is whole numbers: x.s counts shared hyperedges with all members, |s|^2 sums that over them. x.s goes over
    pairs of members or over pairs of a node's hyperedges, whichever are fewer, or by matrix where hyperedges are few.
    """
    size = inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q"))
    degree = inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("norm"))
    pairs = lambda counts, name: counts.agg(F.sum(F.col(name) * F.col(name))).first()[0] or 0
    of_nodes, of_edges, m = pairs(degree, "norm"), pairs(size, "q"), size.count()
    long = {inc.schema[c].dataType.simpleString() for c in ("edge_id", "node_id")} == {"bigint"}
    if long and m <= EDGES and degree.count() * m * m <= PRODUCTS * min(of_nodes, of_edges):
        dot = _dots_by_matrix(inc.filter("edge_id is not null and node_id is not null"))
    else:
        dot = _dots_by_edges(inc) if of_nodes < of_edges else _dots_by_nodes(inc)
    total = dot.groupBy("edge_id").agg(F.sum("dot").alias("ss"))
    d = dot.join(size, "edge_id").join(degree, "node_id").join(total, "edge_id")
    top = F.col("q") * F.col("q") * F.col("norm") - 2 * F.col("q") * F.col("dot") + F.col("ss")
    dist = F.when(F.col("q") > 1, F.greatest(top / ((F.col("q") - 1) * (F.col("q") - 1)), F.lit(0.0))).otherwise(0.0)
    return d.select("edge_id", "node_id", "q", dist.alias("dist"))


def hyperedge_weights(distances: DataFrame, delta: float) -> DataFrame:
    """(edge_id, weight): sum of exp(-dist / delta) over the members, by their number less one; 1 for one member."""
    w = distances.groupBy("edge_id", "q").agg(F.sum(F.exp(-F.col("dist") / delta)).alias("s"))
    return w.select("edge_id", F.when(F.col("q") > 1, F.col("s") / (F.col("q") - 1)).otherwise(1.0).alias("weight"))


def median_scale(distances: DataFrame, first: int = 4096) -> float:
    """Median of the positive distances among the first ones by hyperedge and node."""
    some = distances.orderBy("edge_id", "node_id").limit(first).filter("dist > 0")
    return some.agg(F.percentile("dist", F.lit(0.5))).first()[0] or 1.0


def dominant_label(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, label): the most frequent cluster among a hyperedge's nodes, the lowest on ties."""
    c = inc.join(nodes, "node_id").groupBy("edge_id", "rc").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("edge_id").agg(F.min_by("rc", F.struct(-F.col("n"), "rc")).alias("label"))


def goodman_kruskal(blocks: DataFrame) -> DataFrame:
    """One row (tau_x, tau_y) of blocks (rc, cc, dnz): the share by which knowing one clustering lessens errors on the other."""
    t = blocks.join(F.broadcast(blocks.agg(F.sum("dnz").alias("total")))).select("rc", "cc", (F.col("dnz") / F.col("total")).alias("t"))
    x, y = t.groupBy("rc").agg(F.sum("t").alias("tx")), t.groupBy("cc").agg(F.sum("t").alias("ty"))
    both = t.join(x, "rc").join(y, "cc")
    a = both.agg(F.sum(F.col("t") * F.col("t") / F.col("ty")).alias("ax"), F.sum(F.col("t") * F.col("t") / F.col("tx")).alias("ay"))
    s = x.agg(F.sum(F.col("tx") * F.col("tx")).alias("sx")).join(F.broadcast(y.agg(F.sum(F.col("ty") * F.col("ty")).alias("sy"))))
    share = lambda a, s: F.when(F.col(s) < 1, (F.col(a) - F.col(s)) / (1 - F.col(s))).otherwise(0.0)
    return a.join(F.broadcast(s)).select(share("ax", "sx").alias("tau_x"), share("ay", "sy").alias("tau_y"))


def tensor_tau(tensor: DataFrame, modes: list[str], value: str = "val") -> DataFrame:
    """(mode, tau) of an n-mode tensor in coordinate form, one row per mode j.

    On shares t: the sum over j's slices of their squares by their total, less the sum of squares of the totals over j,
    by one less the latter. With two modes the first one's value is goodman_kruskal's tau_y.
    """
    t = tensor.groupBy(*modes).agg(F.sum(value).alias("v")).join(F.broadcast(tensor.agg(F.sum(value).alias("total"))))
    t = t.select(*modes, (F.col("v") / F.col("total")).alias("t"))
    out = None
    for j, mode in enumerate(modes):
        a = t.groupBy(mode).agg((F.sum(F.col("t") * F.col("t")) / F.sum("t")).alias("x")).agg(F.sum("x").alias("a"))
        b = t.groupBy(*[m for m in modes if m != mode]).agg(F.sum("t").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("b"))
        row = a.join(F.broadcast(b)).select(F.lit(j).cast("long").alias("mode"), F.when(F.col("b") < 1, (F.col("a") - F.col("b")) / (1 - F.col("b"))).otherwise(0.0).alias("tau"))
        out = row if out is None else out.union(row)
    return out


def block_bits(blocks: DataFrame) -> Column:
    """Bits of a block's entries, whose count is given."""
    size, z = F.col("nx") * F.col("ny"), F.col("dnz").cast("double")
    return z * entropy_bits(z / size) + (size - z) * entropy_bits((size - z) / size)


def mdl_cost(blocks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (bits): cluster numbers, assignments, block counts of all blocks, empty ones too, and the entries, rounded up in sum.

    Empty blocks are those of the products of sizes that no nonzero block has, so they aren't listed one by one: block
    counts are summed over pairs of distinct sizes.
    """
    nx, ny = nodes.groupBy("rc").agg(F.count(F.lit(1)).alias("n")), edges.groupBy("cc").agg(F.count(F.lit(1)).alias("n"))

    def assign(sizes: DataFrame, name: str) -> DataFrame:
        total = sizes.agg(F.sum("n").alias("total"))
        return sizes.join(F.broadcast(total)).agg(F.sum(F.col("n") * -F.log2(F.col("n") / F.col("total"))).alias(name), F.count(F.lit(1)).alias(f"k_{name}"))

    by_size = lambda s, c: s.groupBy(F.col("n").alias(c)).agg(F.count(F.lit(1)).alias(f"{c}s"))
    counts = by_size(nx, "a").join(F.broadcast(by_size(ny, "b"))).agg(F.sum(F.col("as") * F.col("bs") * F.log2(F.col("a") * F.col("b") + 1)).alias("counts"))
    entries = blocks.agg(F.ceil(F.round(F.sum(block_bits(blocks)), 6)).alias("entries"))
    row = assign(nx, "x").join(F.broadcast(assign(ny, "y"))).join(F.broadcast(counts)).join(F.broadcast(entries))
    return row.select((log_star_column(F.col("k_x")) + log_star_column(F.col("k_y")) + F.col("x") + F.col("y") + F.col("counts") + F.col("entries")).alias("bits"))


def mdl_init_cost(inc: DataFrame) -> DataFrame:
    """One row (bits): each node and hyperedge a cluster of its own. Blocks of one entry cost a bit for its count and none for it."""
    row = inc.agg(F.count_distinct("node_id").alias("n"), F.count_distinct("edge_id").alias("m"))
    own = lambda c: F.col(c) * F.log2(F.col(c))
    return row.select((log_star_column(F.col("n")) + log_star_column(F.col("m")) + own("n") + own("m") + F.col("n") * F.col("m")).cast("double").alias("bits"))


def merge_deltas(blocks: DataFrame, edges: DataFrame, pairs: DataFrame, weights: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """pairs (c1, c2) of edge clusters with delta, the change of the matrix cost when they merge."""
    ny = edges.groupBy("cc").agg(F.count(F.lit(1)).alias("ny"))
    side = lambda c: blocks.select(F.col("cc").alias(c), "rc", "nx", F.col("dnz").alias(f"z_{c}"))
    p = pairs.join(ny.select(F.col("cc").alias("c1"), F.col("ny").alias("y1")), "c1").join(ny.select(F.col("cc").alias("c2"), F.col("ny").alias("y2")), "c2")
    rows = p.join(side("c1").select("c1", "rc", "nx"), "c1").select("c1", "c2", "y1", "y2", "rc", "nx").union(p.join(side("c2").select("c2", "rc", "nx"), "c2").select("c1", "c2", "y1", "y2", "rc", "nx")).distinct()
    rows = rows.join(side("c1").drop("nx"), ["c1", "rc"], "left").join(side("c2").drop("nx"), ["c2", "rc"], "left").fillna(0, ["z_c1", "z_c2"])

    def cost(z: Column, size: Column) -> Column:
        return F.when(2 * z >= size, weights[1] + weights[2] * (size - z)).otherwise(weights[2] * z)

    nx, z1, z2 = F.col("nx"), F.col("z_c1"), F.col("z_c2")
    delta = cost(z1 + z2, nx * (F.col("y1") + F.col("y2"))) - F.when(z1 > 0, cost(z1, nx * F.col("y1"))).otherwise(0) - F.when(z2 > 0, cost(z2, nx * F.col("y2"))).otherwise(0)
    return rows.groupBy("c1", "c2").agg((F.sum(delta) - weights[0]).cast("long").alias("delta"))


def _by_cluster(tensor: DataFrame, modes: list[str], held: dict[str, DataFrame], but: str | None = None) -> DataFrame:
    """The tensor (modes, val) with each mode's items as their clusters, except those of `but`."""
    t = tensor
    for m in modes:
        if m != but:
            t = t.join(held[m].withColumnRenamed("label", f"to_{m}"), m).drop(m).withColumnRenamed(f"to_{m}", m)
    return t.groupBy(*modes).agg(F.sum("val").alias("val"))


def clustered_tau(tensor: DataFrame, modes: list[str], held: dict[str, DataFrame]) -> DataFrame:
    """tensor_tau() of the clusters held by mode."""
    return tensor_tau(_by_cluster(tensor, modes, held), modes)


def tensor_move(tensor: DataFrame, modes: list[str], mode: str, held: dict[str, DataFrame], prototypes: DataFrame | None = None) -> DataFrame:
    """(mode, label): the cluster to which each of a mode's items moves, by the other modes' clusters held.

    An item goes to the cluster r of the largest sum of t(r, c) / t(c) - t(r) over its entries, c running over combinations
    of the others' clusters; the highest cluster on ties. Sums are split so that only clusters that share a combination
    with an item meet it; the item's total times the least t(r) stands for all others. prototypes (mode, label): items
    that are the clusters, instead of those held.
    """
    others = [m for m in modes if m != mode]
    own = _by_cluster(tensor, modes, held, mode)
    clusters = held[mode] if prototypes is None else prototypes
    t = own.join(clusters, mode).groupBy("label", *others).agg(F.sum("val").alias("z"))
    of_all = own.groupBy(*others).agg(F.sum("val").alias("zy")) if prototypes is not None else t.groupBy(*others).agg(F.sum("z").alias("zy"))
    total = t.agg(F.sum("z").alias("total"))
    x = t.groupBy("label").agg(F.sum("z").alias("zx")).join(F.broadcast(total)).select("label", (F.col("zx") / F.col("total")).alias("share"))
    met = own.join(t, others).join(of_all, others).groupBy(mode, "label").agg(F.sum(F.col("val") * F.col("z") / F.col("zy")).alias("gain"))
    n = own.groupBy(mode).agg(F.sum("val").alias("n"))
    near = met.join(x, "label").join(n, mode).select(mode, "label", F.round(F.col("gain") - F.col("n") * F.col("share"), 9).alias("s"))
    # Clusters that share nothing with an item score -n share: of those with the least share, the highest stands for all.
    rest = x.agg(F.min(F.struct("share", -F.col("label"))).alias("r")).select(F.col("r.share").alias("share"), (-F.col("r.col2")).alias("label"))
    far = n.join(F.broadcast(rest)).select(mode, "label", F.round(-F.col("n") * F.col("share"), 9).alias("s"))
    # If that one is met by the item, its score there is no less, so both may stand.
    return near.union(far.select(*near.columns)).groupBy(mode).agg(F.max_by("label", F.struct("s", "label")).alias("label"))


def tau_row_move(inc: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label): tensor_move() of the nodes of an incidence."""
    held = {"node_id": nodes.withColumnRenamed("rc", "label"), "edge_id": edges.withColumnRenamed("cc", "label")}
    return tensor_move(inc.select("node_id", "edge_id", F.lit(1).alias("val")), ["node_id", "edge_id"], "node_id", held)


def centers(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rc, i, c): each cluster's mean vector, a row per component; vectors (node_id, v)."""
    each = vectors.join(nodes, "node_id").select("rc", F.posexplode("v").alias("i", "x"))
    return each.groupBy("rc", "i").agg(F.avg("x").alias("c"))


def _distances(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """(node_id, rc, d): squared distances of all nodes to all clusters' centers, a row of which is (k x dim) numbers."""
    whole = means.groupBy("rc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c"))
    listed = whole.agg(F.collect_list(F.struct("rc", "c")).alias("all"))
    each = vectors.join(F.broadcast(listed)).select("node_id", "v", F.explode("all").alias("m"))
    d = F.aggregate(F.zip_with("v", "m.c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return each.select("node_id", F.col("m.rc").alias("rc"), d.alias("d"))


def icm_objective(inc: DataFrame, vectors: DataFrame, nodes: DataFrame, means: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """One row: squared distances of nodes to their clusters' centers, and alpha times the weight of hyperedges by pairs of members in different clusters."""
    far = _distances(vectors, means).join(nodes, ["node_id", "rc"]).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("far"))
    c = inc.join(nodes, "node_id").groupBy("edge_id", "rc").agg(F.count(F.lit(1)).alias("n"))
    pairs = c.groupBy("edge_id").agg(F.sum("n").alias("q"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    apart = pairs.join(weights, "edge_id").agg(F.coalesce(F.sum(F.col("weight") * (F.col("q") * (F.col("q") - 1) / 2 - F.col("same"))), F.lit(0.0)).alias("apart"))
    return far.join(F.broadcast(apart)).select((F.col("far") + alpha * F.col("apart")).alias("objective"))


def icm_move(inc: DataFrame, vectors: DataFrame, nodes: DataFrame, means: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """(node_id, label): each node's cheapest cluster, the lowest on ties: squared distance, and alpha times, over its hyperedges, the weight by other members in other clusters."""
    w = inc.join(weights, "edge_id")
    c = inc.join(nodes, "node_id").groupBy("edge_id", "rc").agg(F.count(F.lit(1)).alias("n"))
    size = inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q"))
    every = w.join(size, "edge_id").groupBy("node_id").agg(F.sum(F.col("weight") * (F.col("q") - 1)).alias("every"), F.sum("weight").alias("own"))
    with_it = w.join(c, "edge_id").groupBy("node_id", "rc").agg(F.sum(F.col("weight") * F.col("n")).alias("near"))
    mine = nodes.withColumnRenamed("rc", "mine")
    x = _distances(vectors, means).join(mine, "node_id").join(every, "node_id", "left").join(with_it, ["node_id", "rc"], "left").fillna(0.0, ["every", "own", "near"])
    others = F.col("every") - F.col("near") + F.when(F.col("rc") == F.col("mine"), F.col("own")).otherwise(0.0)
    return x.groupBy("node_id").agg(F.min_by("rc", F.struct(F.round(F.col("d") + alpha * others, 9).alias("cost"), "rc")).alias("label"))


def homogeneity_cost(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, cost): over a node's hyperedges, the other members that are in another cluster."""
    c = inc.join(nodes, "node_id").groupBy("edge_id", "rc").agg(F.count(F.lit(1)).alias("same"))
    size = inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q"))
    e = inc.join(nodes, "node_id").join(c, ["edge_id", "rc"]).join(size, "edge_id")
    return e.groupBy("node_id").agg(F.sum(F.col("q") - F.col("same")).alias("cost"))


def walk_pairs(walks: DataFrame, window: int) -> DataFrame:
    """(target, context, n) of walks (walk_id, step, item): symmetric pairs at offsets 1 to window."""
    w = Window.partitionBy("walk_id").orderBy("step")
    far = [F.struct(F.col("item").alias("a"), F.lead("item", k).over(w).alias("b")) for k in range(1, window + 1)]
    p = walks.select(F.array(*far).alias("far")).select(F.explode("far").alias("p")).select("p.*").filter("b is not null")
    return p.union(p.select("b", "a")).groupBy(F.col("a").alias("target"), F.col("b").alias("context")).agg(F.count(F.lit(1)).alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(target, context, value): positive pointwise mutual information, ln(n N / (row * column)); others are left out."""
    r, c = pairs.groupBy("target").agg(F.sum("n").alias("r")), pairs.groupBy("context").agg(F.sum("n").alias("c"))
    v = pairs.join(r, "target").join(c, "context").join(F.broadcast(pairs.agg(F.sum("n").alias("total"))))
    v = v.withColumn("value", F.ln(F.col("n") * F.col("total") / (F.col("r") * F.col("c")).cast("double")))
    return v.filter("value > 0").select("target", "context", "value")


def knn_hypergraph(points: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(vec_id, neighbor_id, rank) of the k nearest others by squared distance, ties to the smaller id.

    All pairs are compared, in blocks: each pair of blocks of points is one task's matrix products. What their rounding
    leaves unsure, ties too, is told by the differences themselves; only the k best of each point go on.
    """
    import numpy as np
    import pandas as pd

    n = max(1, -(-points.count() // block))
    p = points.select("vec_id", "embedding").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    single = points.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "ids": [pdf["vec_id"].to_numpy("int64").tobytes()], "vectors": [np.concatenate(pdf["embedding"].to_numpy()).astype(kind).tobytes()]})

    blocks = cut(p.groupBy("part").applyInPandas(whole, "part long, ids binary, vectors binary"))
    left = blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    right = blocks.select(F.col("part").alias("to"), F.col("ids").alias("ids2"), F.col("vectors").alias("vectors2"))

    def nearest(a, x, b, y, yy):
        """Places in a and b, and distances, of the k nearest of b to each of a."""
        xx = np.einsum("ij,ij->i", x, x)
        with np.errstate(all="ignore"):
            d = xx[:, None] + yy - 2 * (x @ y.T)
        d[~np.isfinite(d)] = np.inf
        d[a[:, None] == b] = np.inf
        # Twice what rounding can make of a sum of such products.
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + np.max(yy, where=np.isfinite(yy), initial=0.0))
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        rows, cols = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
        exact = np.concatenate([((y[cols[i : i + 65536]] - x[rows[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        order = np.lexsort((b[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[first], cols[first], exact[first]

    def best(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                a, b = np.frombuffer(row.ids, "int64"), np.frombuffer(row.ids2, "int64")
                x, y = np.frombuffer(row.vectors, kind).reshape(len(a), -1).astype(float), np.frombuffer(row.vectors2, kind).reshape(len(b), -1).astype(float)
                yy = np.einsum("ij,ij->i", y, y)
                for i in range(0, len(a), 256):
                    rows, cols, d = nearest(a[i : i + 256], x[i : i + 256], b, y, yy)
                    yield pd.DataFrame({"vec_id": a[i : i + 256][rows], "neighbor_id": b[cols], "d": d})

    pairs = left.join(right, "to").select("ids", "vectors", "ids2", "vectors2").repartition(max(1, min(n * n, 2000)))
    found = pairs.mapInPandas(best, "vec_id long, neighbor_id long, d double")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbor_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "d")


def sparse_neighbours(inc: DataFrame, k: int) -> DataFrame:
    """(node_id, neighbor_id, rank, d): the k nearest other nodes by squared distance of incidence rows, ties to the smaller id.

    Rows of nodes that share no hyperedge are as far apart as their sizes add up to, so beside the nodes that share one
    only the first k of the others by size count: those are among the first k + (nodes that share one) of all.
    """
    size = inc.groupBy("node_id").agg(F.count(F.lit(1)).alias("s"))
    other = inc.select("edge_id", F.col("node_id").alias("neighbor_id"))
    both = inc.join(other, "edge_id").filter("node_id <> neighbor_id").groupBy("node_id", "neighbor_id").agg(F.count(F.lit(1)).alias("both"))
    of = size.select(F.col("node_id").alias("neighbor_id"), F.col("s").alias("t"))
    near = both.join(size, "node_id").join(of, "neighbor_id").select("node_id", "neighbor_id", (F.col("s") + F.col("t") - 2 * F.col("both")).alias("d"))
    met = both.groupBy("node_id").agg(F.count(F.lit(1)).alias("met"))
    from .relational import positions

    placed = positions(size, [F.col("s"), F.col("node_id")]).select(F.col("node_id").alias("neighbor_id"), F.col("s").alias("t"), "position")
    wanted = size.join(met, "node_id", "left").withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("met", F.lit(0)) + k)))
    far = wanted.join(placed, "position").filter("node_id <> neighbor_id").join(both, ["node_id", "neighbor_id"], "left_anti")
    far = far.select("node_id", "neighbor_id", (F.col("s") + F.col("t")).alias("d"))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("d", "neighbor_id"))
    return near.union(far).withColumn("rank", nth).filter(F.col("rank") <= k).select("node_id", "neighbor_id", "rank", F.col("d").cast("double").alias("d"))


def affinity(neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, w), degrees (a, degree)) of the hypergraph whose hyperedges are each node and its neighbours (node_id, neighbor_id, d).

    A hyperedge weighs the sum over its members of exp(-d / mean d), itself with d = 0; all alike weigh 1. A pair's
    affinity is the sum over the hyperedges that hold both, itself with itself too, of weight / size; a node's degree is
    the sum of its hyperedges' weights.
    """
    own = neighbours.select(F.col("node_id").alias("e")).distinct().withColumns({"a": F.col("e"), "d": F.lit(0.0)})
    members = neighbours.select(F.col("node_id").alias("e"), F.col("neighbor_id").alias("a"), "d").union(own)
    scale = members.withColumn("mean", F.avg("d").over(Window.partitionBy("e")))
    w = scale.groupBy("e").agg(F.sum(F.when(F.col("mean") > 0, F.exp(-F.col("d") / F.col("mean"))).otherwise(1.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    m = members.join(w, "e").select("e", "a", "w", "n")
    pairs = m.join(m.select("e", F.col("a").alias("b")), "e").groupBy("a", "b").agg(F.sum(F.col("w") / F.col("n")).alias("w"))
    return pairs, m.groupBy("a").agg(F.sum("w").alias("degree"))


def knn_weights(neighbours: DataFrame) -> DataFrame:
    """(vec_id, weight): the neighbour hyperedge of a point: the sum over it and its neighbours of exp(-d / mean d), itself with 0; 1 per member if all are equal."""
    d = neighbours.withColumn("mean", F.sum("d").over(Window.partitionBy("vec_id")) / (F.count(F.lit(1)).over(Window.partitionBy("vec_id")) + 1))
    e = F.when(F.col("mean") > 0, F.exp(-F.col("d") / F.col("mean"))).otherwise(1.0)
    return d.groupBy("vec_id").agg((1 + F.sum(e)).alias("weight"))
