"""Summaries by search: LSH proposes groups of similar clusters, tasks merge within groups, a pass is kept if the cost falls."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored
from . import metrics, summary
from .relational import PRIME, linear_hash, linear_terms

#: Parts of a sweep in which nodes move at the same time.
HALVES = 2
#: Slots of a hash space that orders items of a sample; see random_clusters().
SLICES = 4096
#: Columns of a basis that a search for singular vectors holds.
BASIS = 96


def minhash_groups(inc: DataFrame, rows: int, seed: int = 0, bands: int = 1) -> DataFrame:
    """(edge_id, group): hyperedges of the same `rows` least node hashes in some of `bands` bands.

    The group is the smallest hyperedge that one shares a bucket with, in any band, so groups are disjoint. Hashes are
    linear ones, which any SQL engine can compute.
    """
    if not rows:
        return inc.select("edge_id").distinct().withColumn("group", F.lit(0).cast("long"))
    each = inc.withColumn("i", _each(rows * bands)).groupBy("edge_id", "i").agg(F.min(_hashed("node_id", seed, rows * bands)).alias("h"))
    return _named(each, "edge_id", rows)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _hashed(key: str, seed: int, n: int, of: int = 1, nth: int = 0) -> Column:
    """The hash number i, or of * i + nth, of an id, i being a column below n."""
    terms = [linear_terms(seed * 1000 + of * i + nth) for i in range(n)]
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]).cast("long") for t in terms]), F.col("i") + 1)
    return linear_hash(F.col(key), pick(0), pick(1))


def cosine_groups(blocks: DataFrame, rows: int, seed: int = 0, bands: int = 1) -> DataFrame:
    """(cc, group): edge clusters whose density columns lie on the same sides of `rows` random hyperplanes, in some of `bands` bands; see minhash_groups()."""
    n = rows * bands
    u = lambda j: (_hashed("rc", seed, n, 2, j) + 0.5) / float(PRIME)
    normal = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))
    density = F.col("dnz") / (F.col("nx") * F.col("ny"))
    each = blocks.withColumn("i", _each(n)).groupBy("cc", "i").agg(F.signum(F.round(F.sum(density * normal), 9)).cast("long").alias("h"))
    return _named(each, "cc", rows)


def _named(each: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, group) of hashes (key, i, h), of which `rows` make a band: the smallest key that shares a whole band."""
    bands = each.groupBy(key, F.floor(F.col("i") / rows).alias("band")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("sig"))
    bands = cut(bands.select(key, F.xxhash64("band", F.transform("sig", lambda x: x["h"])).alias("sig")))
    return bands.join(bands.groupBy("sig").agg(F.min(key).alias("least")), "sig").groupBy(key).agg(F.min("least").alias("group"))


def storage_block(z: float, size: float) -> float:
    """Cost of a block: an entry of its superedge and the misses if at least half full, else its entries."""
    return (1 + size - z if 2 * z >= size else z) if z else 0.0


def mdl_block(z: float, size: float) -> float:
    """Bits of a block: its count's and its entries'."""
    h = 0.0
    for part in (z, size - z):
        if part > 0:
            h -= part * math.log2(part / size)
    return math.log2(size + 1) + h


def merge_within(blocks: DataFrame, groups: DataFrame, block_cost: Callable[[float, float], float], per_cluster: float, rows: int, min_size: int, max_trials: int, heights: list[tuple[int, int]]) -> DataFrame:
    """(cc, new_cc): clusters merged within their groups.

    In each group of at least min_size clusters, a live cluster, the smallest first, absorbs others in order while the cost
    does not grow; with one-row signatures it stops after max_trials failures, else at the first. A merged cluster has its
    smallest id. Groups are disjoint, so given the other side's clusters, merges in different groups don't meet.
    heights: (size, count) of the other side's clusters, for costs of empty blocks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols: dict[int, dict[int, int]] = {}
        width, height = {}, {}
        for c, r, z, nx, ny in zip(pdf["cc"], pdf["rc"], pdf["dnz"], pdf["nx"], pdf["ny"], strict=True):
            cols.setdefault(int(c), {})[int(r)] = int(z)
            width[int(c)], height[int(r)] = int(ny), int(nx)
        home = {c: c for c in cols}
        if len(cols) >= min_size:

            def delta(a: int, b: int) -> float:
                d, both = -per_cluster, width[a] + width[b]
                rs = cols[a].keys() | cols[b].keys()
                for r in rs:
                    za, zb, h = cols[a].get(r, 0), cols[b].get(r, 0), height[r]
                    d += block_cost(za + zb, h * both) - block_cost(za, h * width[a]) - block_cost(zb, h * width[b])
                if block_cost(0, 2):  # empty blocks cost as well
                    rest = {h: n for h, n in heights}
                    for r in rs:
                        rest[height[r]] = rest.get(height[r], 0) - 1
                    d += sum(n * (block_cost(0, h * both) - block_cost(0, h * width[a]) - block_cost(0, h * width[b])) for h, n in rest.items() if n > 0)
                return d

            live = sorted(cols)
            while live:
                a = live.pop(0)
                failed = 0
                for b in list(live):
                    if delta(a, b) <= 1e-9:
                        for r, z in cols.pop(b).items():
                            cols[a][r] = cols[a].get(r, 0) + z
                        width[a] += width[b]
                        home[b] = a
                        live.remove(b)
                    else:
                        failed += 1
                        if failed >= (max_trials if rows == 1 else 1):
                            break
        return pd.DataFrame({"cc": list(home), "new_cc": list(home.values())})

    # Groups that are too small to merge don't go to Python.
    large = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, min_size)).select("group")
    merged = cut(blocks.join(groups.join(large, "group"), "cc").groupBy("group").applyInPandas(run, "cc long, new_cc long"))
    return blocks.select("cc").distinct().join(merged, "cc", "left").select("cc", F.coalesce("new_cc", "cc").alias("new_cc"))


def costs(kind: str, inc: DataFrame, nodes: DataFrame, edges: DataFrame) -> float:
    blocks = summary.block_counts(inc, nodes, edges)
    row = summary.matrix_cost(blocks, edges) if kind == "storage" else metrics.mdl_cost(blocks, nodes, edges)
    return float(row.first()[0])


def search(
    inc: DataFrame,
    kind: str = "storage",
    seed: int = 0,
    cost_threshold: float = 1.0,
    min_size: int = 2,
    max_trials: int = 5,
    max_no_improvements: int = 2,
    max_rounds: int = 50,
    rows: int = 20,
    bands: int = 5,
    last_bands: int = 100,
    trace: list | None = None,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Node clusters (node_id, rc), edge clusters (edge_id, cc) and the costs of the accepted states.

    kind 'storage': the storage cost; 'mdl': bits. Hyperedges with equal MinHash signatures merge first, then nodes; passes
    over columns and rows follow, by signs of random projections, with fewer and fewer rows, round(rows / 1.2^(i - 1)), in
    more and more bands, round(bands * 1.2^(i - 1)), until max_no_improvements passes in a row are rejected or max_rounds
    rounds are over; then rounds with one row and last_bands bands until as many are rejected. A pass is kept if the cost
    falls by cost_threshold: for 'storage', below 1 a share of the current cost; for 'mdl', in bits. Random numbers are
    hashed from ids and seed. trace, if given, gets (round, side, rows, bands, seconds, change of cost, kept) of each pass.
    """
    inc = cut(inc)
    nodes, edges = cut(inc.select("node_id").distinct().withColumn("rc", F.col("node_id"))), cut(inc.select("edge_id").distinct().withColumn("cc", F.col("edge_id")))
    block_cost, per_cluster = (storage_block, 1.0) if kind == "storage" else (mdl_block, 0.0)
    history = [costs(kind, inc, nodes, edges)]

    def one_pass(nodes: DataFrame, edges: DataFrame, columns: bool, r: int, b: int, by_set: bool, salt: int) -> tuple[DataFrame, DataFrame]:
        blocks = cut(summary.block_counts(inc, nodes, edges))
        if not columns:  # rows are the columns of the transposed blocks
            blocks = blocks.select(F.col("cc").alias("rc"), F.col("rc").alias("cc"), "dnz", F.col("ny").alias("nx"), F.col("nx").alias("ny"))
        if by_set:
            side = inc if columns else inc.select(F.col("node_id").alias("edge_id"), F.col("edge_id").alias("node_id"))
            groups = minhash_groups(side, r, salt, b).withColumnRenamed("edge_id", "cc")
        else:
            groups = cosine_groups(blocks, r, salt, b)
        # What empty blocks cost depends on their heights alone; the storage cost has none for them.
        heights = [] if not block_cost(0, 2) else [(x["nx"], x["count"]) for x in blocks.select("rc", "nx").distinct().groupBy("nx").count().collect()]
        merged = merge_within(blocks, groups, block_cost, per_cluster if columns else 0.0, r, min_size, max_trials, heights)
        if columns:
            return nodes, cut(edges.join(merged, "cc").select("edge_id", F.col("new_cc").alias("cc")))
        return cut(nodes.join(merged.withColumnRenamed("cc", "rc"), "rc").select("node_id", F.col("new_cc").alias("rc"))), edges

    rejected, salt = 0, seed * 100_000

    def round_of(i: int, r: int, b: int, by_set: bool) -> None:
        nonlocal nodes, edges, rejected, salt
        for columns in (True, False):
            salt += 1
            began = time.time()
            n, e = one_pass(nodes, edges, columns, r, b, by_set, salt)
            fall = history[-1] - costs(kind, inc, n, e)
            need = cost_threshold * history[-1] if kind == "storage" and cost_threshold < 1 else cost_threshold
            if kept := fall >= need and fall > 0:
                nodes, edges, rejected = n, e, 0
                history.append(history[-1] - fall)
            else:
                rejected += 1
            if trace is not None:
                trace.append((i, "columns" if columns else "rows", r, b, time.time() - began, -fall, kept))

    round_of(0, rows, bands, True)
    rejected = 0
    for i in range(1, max_rounds + 1):
        if rejected >= max_no_improvements:
            break
        round_of(i, max(1, round(rows / 1.2 ** (i - 1))), round(bands * 1.2 ** (i - 1)), False)
    rejected = 0
    for i in range(1, max_rounds + 1):
        if rejected >= max_no_improvements:
            break
        round_of(max_rounds + i, 1, last_bands, False)
    return nodes, edges, history


def random_clusters(items: DataFrame, key: str, k: int, seed: int = 0, same_size: bool = True) -> DataFrame:
    """items (key) with label in 0..k-1 in a hashed order: sizes of floor(n / k), the last takes the rest; or each at random."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    if not same_size:
        return items.select(key).distinct().withColumn("label", F.pmod(h, F.lit(k)).cast("long"))
    d = items.select(key).distinct().withColumn("h", h).withColumn("slice", F.floor((F.col("h").cast("double") / 2.0**63 + 1) * (SLICES / 2)).cast("int"))
    counts = d.groupBy("slice").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    n = d.count()
    nth = F.row_number().over(Window.partitionBy("slice").orderBy("h", key)) - 1 + F.col("before")
    return d.join(F.broadcast(counts), "slice").select(key, F.least(F.floor(nth / max(1, n // k)), F.lit(k - 1)).cast("long").alias("label"))


def tensor_start(tensor: DataFrame, modes: list[str], sizes: list[int], seed: int = 0, start: str = "random") -> dict[str, DataFrame]:
    """mode -> (mode, label): first clusters of each mode's items.

    random: equal parts of a hashed order; discrete: each item its own; centroids: `sizes` items in a hashed order are
    prototypes, and each item goes to the best one by the others' items as they are.
    """
    out = {}
    for j, (mode, k) in enumerate(zip(modes, sizes, strict=True)):
        if start == "random":
            out[mode] = random_clusters(tensor, mode, k, seed + j)
        elif start == "discrete":
            out[mode] = tensor.select(mode).distinct().withColumn("label", F.col(mode).cast("long"))
        elif start == "centroids":
            picked = tensor.select(mode).distinct().orderBy(F.xxhash64(mode, F.lit(seed + j)), mode).limit(k)
            picked = picked.withColumn("label", (F.row_number().over(Window.orderBy(mode)) - 1).cast("long"))  # k rows
            own = {m: tensor.select(m).distinct().withColumn("label", F.col(m).cast("long")) for m in modes if m != mode}
            out[mode] = metrics.tensor_move(tensor, modes, mode, own, picked)
        else:
            raise ValueError(f"unknown start {start}")
        out[mode] = cut(out[mode])
    return out


def tensor_search(tensor: DataFrame, modes: list[str], sizes: list[int], seed: int = 0, max_iterations: int = 10, per_mode: int = 100, start: str = "random", value: str = "val") -> tuple[dict[str, DataFrame], list[DataFrame], int]:
    """Clusters of every mode of a tensor (modes, value) by moves to the best prototype: mode -> (mode, label), the taus before and after, and moves.

    In each iteration the modes take turns, each moving until no item moves or per_mode moves are made; it ends when a
    whole iteration moves nothing. Clusters may vanish.
    """
    tensor = cut(tensor.select(*modes, F.col(value).alias("val")))
    held = tensor_start(tensor, modes, sizes, seed, start)
    taus, moves = [cut(metrics.clustered_tau(tensor, modes, held))], 0
    for _ in range(max_iterations):
        before = moves
        for mode in modes:
            for _ in range(per_mode):
                new = cut(metrics.tensor_move(tensor, modes, mode, held))
                if new.join(held[mode], [mode, "label"], "left_anti").isEmpty():
                    break
                held[mode] = new
                moves += 1
        if moves == before:
            break
    return held, [*taus, metrics.clustered_tau(tensor, modes, held)], moves


def tau_search(inc: DataFrame, k: int, l: int, seed: int = 0, max_iterations: int = 10, start: str = "random") -> tuple[DataFrame, DataFrame, int]:
    """Node and edge clusters by alternating single moves to the best prototype, until none moves; clusters may vanish. Also: iterations."""
    inc = cut(inc.select("edge_id", "node_id"))
    tensor = inc.withColumn("val", F.lit(1))
    held = tensor_start(tensor, ["node_id", "edge_id"], [k, l], seed, start)
    for i in range(max_iterations):
        moved = False
        for mode in ("node_id", "edge_id"):
            new = cut(metrics.tensor_move(tensor, ["node_id", "edge_id"], mode, held))
            moved |= not new.join(held[mode], [mode, "label"], "left_anti").isEmpty()
            held[mode] = new
        if not moved:
            break
    return held["node_id"].withColumnRenamed("label", "rc"), held["edge_id"].withColumnRenamed("label", "cc"), i + 1


def icm(inc: DataFrame, vectors: DataFrame, weights: DataFrame, k: int, alpha: float = 0.5, max_iterations: int = 20, seed: int = 0, start: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """(node_id, rc) and the objectives: clusters of nodes (node_id, v) by distances and by hyperedges whose members disagree.

    Iterated conditional modes from k-means (or start): the objective is metrics.icm_objective(). In a sweep the nodes
    move in HALVES hashed parts, one after the other, each node to its cheapest cluster by metrics.icm_move(), given all
    others as they are; a part's moves are kept if the objective falls, else half of them are tried, by hash, and so on.
    No cluster is emptied: its node of smallest id stays if all would leave. It ends when a sweep keeps no move.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    inc, vectors, weights = cut(inc.select("edge_id", "node_id")), cut(vectors), cut(weights)
    if start is None:
        points = vectors.select("node_id", array_to_vector("v").alias("features"))
        start = KMeans(k=k, seed=seed, predictionCol="rc").fit(points).transform(points).select("node_id", F.col("rc").cast("long").alias("rc"))
    held = cut(start)
    centers = cut(metrics.centers(vectors, held))
    value = lambda h, c: float(metrics.icm_objective(inc, vectors, h, c, weights, alpha).first()[0])
    history = [value(held, centers)]
    for i in range(max_iterations):
        kept = 0
        for part in range(HALVES):
            best = metrics.icm_move(inc, vectors, held, centers, weights, alpha)
            mine = F.pmod(F.xxhash64("node_id", F.lit(seed + i)), F.lit(HALVES)) == part
            moves = best.join(held, "node_id").filter(mine & (F.col("label") != F.col("rc"))).select("node_id", "label", "rc")
            left = held.join(moves.select("node_id"), "node_id", "left_anti").groupBy("rc").agg(F.count(F.lit(1)).alias("left"))
            last = moves.join(left, "rc", "left_anti").groupBy("rc").agg(F.min("node_id").alias("node_id"))
            moves = cut(moves.join(last.select("node_id"), "node_id", "left_anti"))
            share = 1
            while share <= 64 and not moves.isEmpty():
                some = moves.filter(F.pmod(F.xxhash64("node_id", F.lit(seed + i + 1)), F.lit(share)) == 0)
                new = cut(held.join(some.select("node_id", "label"), "node_id", "left").select("node_id", F.coalesce("label", "rc").alias("rc")))
                if (v := value(new, centers)) < history[-1] - 1e-9:
                    held, kept = new, kept + 1
                    history.append(v)
                    break
                share *= 2
        # New centers don't raise the objective.
        centers = cut(metrics.centers(vectors, held))
        history.append(value(held, centers))
        if not kept:
            break
    return held, history


def random_walks(inc: DataFrame, weights: DataFrame, n_walks: int, length: int, seed: int = 0) -> DataFrame:
    """(walk_id, step, item): from each node n_walks walks; a step goes to a hyperedge by weight, then to any of its nodes, itself too."""
    by_node = Window.partitionBy("node_id").orderBy("edge_id")
    up, whole = by_node.rowsBetween(Window.unboundedPreceding, 0), by_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = inc.groupBy("edge_id").agg(F.count(F.lit(1)).alias("q"))
    w = inc.join(weights, "edge_id").join(size, "edge_id")
    w = w.select("node_id", "edge_id", "q", ((F.sum("weight").over(up) - F.col("weight")) / F.sum("weight").over(whole)).alias("lo"), (F.sum("weight").over(up) / F.sum("weight").over(whole)).alias("hi"))
    # A node's hyperedges as a list, so a walk meets one row.
    w = stored(w.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("edge_id", "q", "lo", "hi"))).alias("at")))
    by_edge = F.row_number().over(Window.partitionBy("edge_id").orderBy("node_id")) - 1
    members = stored(inc.select("edge_id", "node_id", by_edge.cast("long").alias("nth")))
    u = lambda step, x: F.pmod(F.xxhash64("walk_id", F.lit(step), F.lit(seed), F.lit(x)), F.lit(1 << 53)) / float(1 << 53)
    at = inc.select("node_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))))
    at = cut(at.select(F.xxhash64("node_id", "i").alias("walk_id"), "node_id"))
    out = at.select("walk_id", F.lit(0).alias("step"), F.col("node_id").alias("item"))
    for step in range(1, length):
        e = at.withColumn("u", u(step, 0)).join(w, "node_id")
        hit = F.filter("at", lambda x: (F.col("u") >= x["lo"]) & ((F.col("u") < x["hi"]) | (x["hi"] >= 1) & (x["lo"] < 1)))
        e = e.select("walk_id", F.get(hit, F.lit(0)).alias("to")).filter("to is not null").select("walk_id", "to.edge_id", "to.q")
        # The place of the next node is part of the key, so a walk meets one member, not all.
        at = cut(e.select("walk_id", "edge_id", F.floor(u(step, 1) * F.col("q")).alias("nth")).join(members, ["edge_id", "nth"]).select("walk_id", "node_id"))
        out = out.union(at.select("walk_id", F.lit(step), "node_id"))
    return out


def gahgc(inc: DataFrame, k: int, n_walks: int = 50, length: int = 50, window: int = 5, dim: int = 8, seed: int = 0, backend: str = "svd", alpha: float = 0.5, max_iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """Node and edge clusters: weighted walks, embedding (PPMI and truncated SVD, or word2vec), icm(), dominant labels of hyperedges."""
    from pyspark.ml.functions import vector_to_array

    if k < 2 or n_walks < 1 or length < 2 or window < 1 or dim < 1:
        raise ValueError("k and length must be at least 2, the others at least 1")
    d = cut(metrics.edge_distances(inc))
    weights = cut(metrics.hyperedge_weights(d, metrics.median_scale(d)))
    walks = cut(random_walks(inc, weights, n_walks, length, seed))
    ids = cut(inc.select("node_id").distinct())
    if backend == "word2vec":
        from pyspark.ml.feature import Word2Vec

        words = walks.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "item"))), lambda x: x["item"].cast("string")).alias("words"))
        model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, seed=seed, inputCol="words", outputCol="v").fit(words)
        vectors = model.getVectors().select(F.col("word").cast("long").alias("node_id"), vector_to_array("vector").alias("v"))
    elif backend == "svd":
        columns = stored(relabel(ids))
        p = metrics.ppmi(stored(metrics.walk_pairs(walks, window))).join(columns.select(F.col("node_id").alias("context"), "label"), "context")
        rows = p.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("label", "value"))).alias("xs"))
        rows = rows.join(columns.withColumnRenamed("label", "place"), F.col("target") == F.col("node_id"))
        rows = stored(rows.select("place", F.col("xs.label").alias("at"), F.col("xs.value").alias("x")))
        found = _placed(columns, left_vectors(rows, columns.count(), dim, seed))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        vectors = found.select("node_id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("v"))
    else:
        raise ValueError(f"unknown backend {backend}")
    size = vectors.select(F.size("v")).first()[0]
    placed = ids.join(vectors, "node_id", "left").withColumn("v", F.coalesce("v", F.array(*[F.lit(0.0)] * size)))
    nodes, _ = icm(inc, placed, weights, k, alpha, max_iterations, seed)
    return nodes, cut(metrics.dominant_label(inc, nodes).withColumnRenamed("label", "cc"))


def left_vectors(rows: DataFrame, n: int, k: int, seed: int = 0, tolerance: float = 0.01) -> np.ndarray:
    """The k leading left singular vectors of a symmetric matrix of n rows (place, at, x: columns and values), as columns.

    Block Lanczos with thick restarts: tasks multiply their rows with 8 vectors more than k, of n numbers each, which the
    driver holds, BASIS at most. There is no limit on the products: it ends when each of the k Ritz pairs has a residual
    of at most tolerance times the largest value. Matrices of up to BASIS rows are solved exactly. Values of 1e-9 of the
    largest one and less are left out.
    """
    sc, block = rows.sparkSession.sparkContext, k + 8
    basis = max(BASIS, 4 * block)

    def product(q: np.ndarray) -> np.ndarray:
        held, out = sc.broadcast(q), np.zeros_like(q)

        def times(batches):
            for b in batches:
                count = b.column("at").value_lengths().to_numpy(zero_copy_only=False)
                at, x, row = b.column("at").flatten().to_numpy(), b.column("x").flatten().to_numpy(), np.repeat(np.arange(len(count)), count)
                y = np.zeros((len(count), held.value.shape[1]))
                for i in range(0, len(at), 65536):
                    r = row[i : i + 65536]
                    first = np.flatnonzero(np.diff(r, prepend=-1))
                    y[r[first]] += np.add.reduceat(held.value[at[i : i + 65536]] * x[i : i + 65536, None], first, axis=0)
                yield pa.RecordBatch.from_pydict({"places": [b.column("place").to_numpy().tobytes()], "y": [y.tobytes()]})

        for r in rows.mapInArrow(times, "places binary, y binary").collect():
            out[np.frombuffer(r["places"], "int64")] = np.frombuffer(r["y"]).reshape(-1, q.shape[1])
        held.destroy()
        return out

    v = np.eye(n) if n <= basis else np.linalg.qr(np.random.default_rng(seed).standard_normal((n, block)))[0]
    av = product(v)
    while True:
        h = v.T @ av
        values, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")
        values, s = values[order], s[:, order]
        left = av @ s[:, :block] - (v @ s[:, :block]) * values[:block]
        if v.shape[1] == n or (np.linalg.norm(left[:, :k], axis=0) <= tolerance * abs(values[0])).all():
            break
        if v.shape[1] + block > basis:
            v, av = v @ s[:, : 2 * block], av @ s[:, : 2 * block]
        # Twice, as rounding leaves parts of v in what is small; what is nothing else is left out.
        for least in (1e-10 * max(abs(values[0]), 1e-300), 0.0):
            left = left - v @ (v.T @ left)
            q, size, _ = np.linalg.svd(left, full_matrices=False)
            left = q[:, size > least]
        left = left[:, : n - v.shape[1]]
        if not left.shape[1]:
            break
        v, av = np.hstack([v, left]), np.hstack([av, product(left)])
    kept = max(1, int((np.abs(values[:k]) > 1e-9 * abs(values[0])).sum()))
    return av @ s[:, :kept] / np.where(values[:kept] == 0, 1.0, values[:kept])


def _placed(columns: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(node_id, v): the rows of vectors of nodes (node_id, label)."""
    held = columns.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"node_id": b.column("node_id"), "v": pa.array(list(held.value[b.column("label").to_numpy()]), pa.list_(pa.float64()))})

    return columns.select("node_id", "label").mapInArrow(rows, "node_id long, v array<double>")


def relabel(ids: DataFrame) -> DataFrame:
    """(node_id, label): dense labels from 0 by id, counted per range of ids."""
    from .relational import cluster_permutation

    return cluster_permutation(ids.withColumn("part", F.floor(F.col("node_id") / 65536)), "node_id", "part").select("node_id", F.col("position").alias("label"))


def _partition_start(x: DataFrame, k: int, seed: int, floor: float) -> DataFrame:
    """(id, v): one of k components is 1, the others floor, columns of unit length: k-means of the rows of x (a, b) as sparse vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizer

    rows = x.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.col("b").cast("string")).alias("at"))
    columns = max(1, x.select("b").distinct().count())
    points = cut(CountVectorizer(inputCol="at", outputCol="features", vocabSize=columns, binary=True).fit(rows).transform(rows).select("id", "features"))
    found = KMeans(k=k, seed=seed, predictionCol="label").fit(points).transform(points)
    v = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == F.col("label"), F.lit(1.0)).otherwise(F.lit(floor)))
    return _normalised(found.select("id", v.alias("v")), k, floor)


def _normalised(f: DataFrame, k: int, floor: float) -> DataFrame:
    """f (id, v) with components of floor at least and columns of unit length."""
    f = cut(f.select("id", F.transform("v", lambda x: F.greatest(x, F.lit(floor))).alias("v")))
    norms = f.agg(*[F.sqrt(F.sum(F.col("v")[j] * F.col("v")[j])) for j in range(k)]).first()
    return f.select("id", F.array(*[F.col("v")[j] / max(norms[j] or 0.0, floor) for j in range(k)]).alias("v"))


def dhcc(
    inc: DataFrame, k: int, l: int, iterations: int = 100, seed: int = 0, neighbours: int = 3, node_weight: float = 100.0, edge_weight: float = 100.0, tolerance: float = 1e-5, ridge: float = 1e-8, floor: float = 1e-12
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Node and edge clusters by tri-factorization X = U S V', smooth on the neighbour hypergraphs of both sides; objectives.

    U and V start from k-means and are updated by multiplication with square roots, their columns then scaled; S is solved
    for. Both are smoothed by the affinities of metrics.affinity() of metrics.sparse_neighbours(). It ends when the
    objective (the squared error and both weighted smoothness terms) changes by tolerance, relatively, or after `iterations`.
    Factors, X and affinities are distributed, the k x k, k x l and l x l algebra is done on the driver.
    """
    import numpy as np

    if not (1 <= k and 1 <= l and neighbours >= 1 and iterations >= 1 and min(node_weight, edge_weight, tolerance) >= 0 and min(ridge, floor) > 0):
        raise ValueError("k, l, neighbours and iterations must be at least 1, weights and tolerance nonnegative, ridge and floor positive")
    inc = cut(inc.select("edge_id", "node_id"))
    flipped = inc.select(F.col("edge_id").alias("node_id"), F.col("node_id").alias("edge_id"))
    x, xt = (i.select(F.col("node_id").alias("a"), F.col("edge_id").alias("b")) for i in (inc, flipped))
    sides = []
    for side in (inc, flipped):
        pairs, degrees = metrics.affinity(cut(metrics.sparse_neighbours(side, neighbours)))
        sides.append((cut(pairs), cut(degrees)))
    u, v = cut(_partition_start(x, k, seed, floor)), cut(_partition_start(xt, l, seed, floor))

    def gram(f: DataFrame, n: int) -> np.ndarray:
        row = f.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(n) for j in range(n)]).first()
        return np.array([y or 0.0 for y in row]).reshape(n, n)

    def sums(pairs: DataFrame, f: DataFrame, n: int, weight: str | None = None) -> DataFrame:
        """(id, x): for each a, the sum over its b of f, weighted."""
        w = F.lit(1.0) if weight is None else F.col(weight)
        return pairs.join(f.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.array(*[F.sum(w * F.col("v")[i]) for i in range(n)]).alias("x"))

    def times(c: str, m: np.ndarray) -> list:
        """The row vector in column c times m, a list of columns."""
        return [sum((F.col(c)[i] * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])]

    def inner(f: DataFrame, g: DataFrame, n: int, m: int) -> np.ndarray:
        row = f.join(g, "id").agg(*[F.sum(F.col("v")[i] * F.col("x")[j]) for i in range(n) for j in range(m)]).first()
        return np.array([y or 0.0 for y in row]).reshape(n, m)

    def core(u: DataFrame, v: DataFrame, xv: DataFrame) -> np.ndarray:
        left, right = gram(u, k) + ridge * np.eye(k), gram(v, l) + ridge * np.eye(l)
        return np.linalg.solve(right.T, np.linalg.solve(left, inner(u, xv, k, l)).T).T

    def update(f: DataFrame, xg: DataFrame, m: np.ndarray, b: np.ndarray, side: tuple[DataFrame, DataFrame], weight: float, n: int) -> DataFrame:
        """f times the square root of (A+ + f B- + weight W f) / (A- + f B+ + weight D f), with A = (X g) m."""
        near = sums(side[0], f, n, "w").withColumnRenamed("x", "near")
        rows = f.join(xg, "id", "left").join(near, "id", "left").join(side[1].withColumnRenamed("a", "id"), "id", "left")
        rows = rows.withColumns({"x": F.coalesce("x", F.array(*[F.lit(0.0)] * m.shape[0])), "near": F.coalesce("near", F.array(*[F.lit(0.0)] * n)), "degree": F.coalesce("degree", F.lit(0.0))})
        plus, minus = times("v", np.maximum(b, 0)), times("v", np.maximum(-b, 0))
        rows = rows.withColumn("a", F.array(*times("x", m)))
        at = lambda j: F.col("a")[j]
        top = [F.greatest(at(j), F.lit(0.0)) + minus[j] + weight * F.col("near")[j] for j in range(n)]
        low = [F.greatest(-at(j), F.lit(0.0)) + plus[j] + weight * F.col("degree") * F.col("v")[j] for j in range(n)]
        new = [F.col("v")[j] * F.sqrt(F.greatest(top[j], F.lit(floor)) / F.greatest(low[j], F.lit(floor))) for j in range(n)]
        return cut(_normalised(rows.select("id", F.array(*new).alias("v")), n, floor))

    def rough(f: DataFrame, side: tuple[DataFrame, DataFrame], n: int) -> float:
        own = f.join(side[1].withColumnRenamed("a", "id"), "id").agg(F.sum(F.col("degree") * F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))).first()[0] or 0.0
        return own - float(np.trace(inner(f, sums(side[0], f, n, "w"), n, n)))

    history, total = [], inc.count()
    xv = cut(sums(x, v, l))
    for _ in range(iterations):
        s = core(u, v, xv)
        u = update(u, xv, s.T, s @ gram(v, l) @ s.T, sides[0], node_weight, k)
        v = update(v, cut(sums(xt, u, k)), s, s.T @ gram(u, k) @ s, sides[1], edge_weight, l)
        xv = cut(sums(x, v, l))
        s = core(u, v, xv)
        error = total - 2 * float((inner(u, xv, k, l) * s).sum()) + float(np.trace(gram(u, k) @ s @ gram(v, l) @ s.T))
        history.append(error + node_weight * rough(u, sides[0], k) + edge_weight * rough(v, sides[1], l))
        if len(history) > 1 and abs(history[-2] - history[-1]) <= tolerance * max(1.0, abs(history[-2])):
            break
    label = lambda f: (F.array_position("v", F.array_max("v")) - 1).cast("long")
    return u.select(F.col("id").alias("node_id"), label(u).alias("rc")), v.select(F.col("id").alias("edge_id"), label(v).alias("cc")), history
