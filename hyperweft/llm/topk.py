"""Operator 1: exact top-k search by inner product: ball trees of shards, branch and bound with shared k-th scores."""

from __future__ import annotations

import io
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a shard and of a leaf, and queries of a block.
SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_ROWS = 512
#: Leaves that queries meet in one product.
LEAVES = 16
#: Vectors on which the routing tree is fitted, and the least of them in a leaf of it. All vectors are routed and indexed.
SAMPLE, ROUTE_ROWS = 20_000, 16
#: Shards whose centres a task holds at a time.
CHUNK = 4096
#: Shards that each query is searched in by rounds: its best one, its next ones, and then all that may still hold one of its k.
NEAREST = 4


#: Bounds are rounded, relatively; scores are whole numbers.
MARGIN = 1e-9


def whole_parts(vector: Column) -> Column:
    """floor(256 * x) of each component, as doubles; null for a vector that is null or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = sys.float_info.max / 256  # so that 256 * x is finite
    return F.when(fine, F.transform(vector, lambda x: _floor(256 * F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double"))))))


def _floor(x: Column) -> Column:
    """Floor as a double: a whole number of any size, where floor() to long would overflow."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def build(ids: np.ndarray, vectors: np.ndarray, least: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A ball tree as arrays: rows in leaf order; per node, level by level, centre, radius, first and last row, first child (0: a leaf), and the plane that parts its children."""
    order = np.argsort(ids, kind="stable")
    first, last, child, centre, radius, normal, offset = [0], [len(ids)], [], [], [], [], []
    i = 0
    while i < len(first):
        a, b = first[i], last[i]
        x = vectors[order[a:b]]
        c = x.mean(axis=0)
        centre.append(c)
        radius.append(math.sqrt(((x - c) ** 2).sum(axis=1).max()))
        normal.append(np.zeros_like(c))
        offset.append(0.0)
        if b - a <= least or not radius[-1]:
            child.append(0)
        else:  # split at the median, along the line between two far points
            p = x[((x - c) ** 2).sum(axis=1).argmax()]
            q = x[((x - p) ** 2).sum(axis=1).argmax()]
            m = (b - a) // 2
            along = x @ (p - q)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            normal[-1], offset[-1] = p - q, float(np.sort(along)[m])
            child.append(len(first))
            first += [a, a + m]
            last += [a + m, b]
        i += 1
    return {"ids": ids[order], "vectors": vectors[order], "centre": np.array(centre), "radius": np.array(radius), "first": np.array(first), "last": np.array(last), "child": np.array(child), "normal": np.array(normal), "offset": np.array(offset)}


def route(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of a tree to which its planes lead each vector."""
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := tree["child"][at] > 0).any():
        i = np.flatnonzero(inner)
        right = (x[i] * tree["normal"][at[i]]).sum(axis=1) >= tree["offset"][at[i]]
        at[i] = tree["child"][at[i]] + right
    return at


def bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with all vectors of balls, rounding allowed for."""
    b = queries @ centre.T + np.sqrt((queries**2).sum(axis=1))[:, None] * radius
    return np.where(np.isnan(b), np.inf, b + MARGIN * (1 + np.abs(b)))  # beyond doubles, nothing is cut


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: doubles where all are below 2**53, else long doubles by integers, those beyond 64 bits as the last ones."""
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1]) < 2**53:
        return queries @ vectors.T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(queries).dot(whole(vectors).T), -(2**63), 2**63 - 1).astype(object).astype(np.longdouble)


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k highest scores, in no order; ties go to the first columns. There are k columns at least."""
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(scores >= least)
    if len(i) > k * len(scores):  # ties for the k-th place
        above, tied = scores > least, scores == least
        i, j = np.nonzero(above | tied & (tied.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return j.reshape(len(scores), k)


def search(tree: dict[str, np.ndarray], qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of each query in a shard, with ids (-1: none), by branch and bound.

    floor: a score for each query that its k-th best is known to reach. A node's upper bound is q.c + |q| r, or its
    parent's if that is less; a node whose bound is below the k-th score so far is cut. Leaves are visited once, by
    descending bound of any query, LEAVES of them in one product with the queries whose bound in one of them still reaches
    their k-th score; a query meets each leaf once at most.
    """
    n = len(qids)
    bound = np.full((n, len(tree["child"])), -np.inf)
    reach = floor.astype(np.float64)
    level = np.array([0])
    parent = np.full((n, 1), np.inf)
    while len(level):
        b = np.minimum(parent, bounds(queries, tree["centre"][level], tree["radius"][level]))
        bound[:, level] = np.where(b >= reach[:, None], b, -np.inf)
        inner = [i for i, x in enumerate(level) if tree["child"][x] and (bound[:, x] > -np.inf).any()]
        parent = np.repeat(bound[:, level[inner]], 2, axis=1)
        level = np.array([c for i in inner for c in (tree["child"][level[i]], tree["child"][level[i]] + 1)], dtype=int)
    leaves = np.flatnonzero(tree["child"] == 0)
    leaves = leaves[np.argsort(-bound[:, leaves].max(axis=0, initial=-np.inf), kind="stable")]
    best, who = np.full((n, k), -np.inf, dtype=np.longdouble), np.full((n, k), -1, dtype=np.int64)
    for x in range(0, len(leaves), LEAVES):
        b = bound[:, leaves[x : x + LEAVES]]
        may = (b >= np.maximum(reach, best[:, k - 1])[:, None]) & (b > -np.inf)
        q, some = np.flatnonzero(may.any(axis=1)), leaves[x : x + LEAVES][may.any(axis=0)]
        if not len(q):
            continue
        rows = np.concatenate([np.arange(tree["first"][i], tree["last"][i]) for i in some])
        rows = rows[np.argsort(tree["ids"][rows], kind="stable")]
        ids, scores = tree["ids"][rows], products(queries[q], tree["vectors"][rows])
        scores[ids[None, :] == qids[q][:, None]] = -np.inf
        ids = np.broadcast_to(ids, scores.shape)
        if len(rows) > k:
            j = highest(scores, k)
            scores, ids = np.take_along_axis(scores, j, 1), np.take_along_axis(ids, j, 1)
        all_s, all_i = np.hstack([best[q], scores]), np.hstack([who[q], ids])
        top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best[q], who[q] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    return best, who


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each row of queries (query_id, embedding), its k rows of vectors (vec_id, embedding) of the highest scores: query_id, rank, vec_id, score.

    Components are floor(256 * x); the score is their inner product, exact, and the last long where it is beyond 64 bits.
    A query's own vec_id is no candidate; ties go to the smaller vec_id; a query with fewer candidates has all. Vectors
    that are null or hold null or non-finite components, and null ids, take no part; shorter vectors count as padded with
    zeros; a query row that repeats another is answered once, a candidate row that repeats another counts again. Empty
    tables give no rows. Other columns are not read.

    A tree of planes, fitted on SAMPLE vectors, routes vectors, so that shards of about SHARD_ROWS of them lie together; a
    leaf of it that has more is dealt over several. Each shard gets a ball tree, written once, and queries are routed in
    the same way, into blocks of about BLOCK_ROWS from successive leaves. Every block is held against the shards' balls, CHUNK at a time; but only those queries of it go
    to a shard whose bound there reaches their k-th score so far. That score is shared after each of three rounds: in a
    query's best shard, in the next ones of its NEAREST, and in all others that may still hold one.
    """
    parts = lambda df, key: df.select(F.col(key).cast("long").alias("id"), whole_parts(F.col("embedding")).alias("v")).filter("id is not null and v is not null")
    v = written(parts(vectors, "vec_id").withColumn("row", F.monotonically_increasing_id()))
    q = written(parts(queries, "query_id").distinct().withColumn("row", F.monotonically_increasing_id()))
    stats = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    sv, sq = stats(v), stats(q)
    dim = max(sv["dim"] or 0, sq["dim"] or 0, 1)

    def matrix(x) -> np.ndarray:
        out = np.zeros((len(x), dim))
        for i, y in enumerate(x):
            out[i, : len(y)] = y
        return out

    def packed(**arrays: np.ndarray) -> bytes:
        f = io.BytesIO()
        np.savez(f, **arrays)
        return f.getvalue()

    unpacked = lambda x: dict(np.load(io.BytesIO(x)))
    some = v.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    router = build(np.arange(len(some)), matrix([x["v"] for x in some]), max(ROUTE_ROWS, len(some) * SHARD_ROWS // max(1, sv["n"]))) if some else None

    def rows_of(column: pa.ListArray) -> np.ndarray:
        if not column.null_count and (column.value_lengths().to_numpy() == dim).all():
            return column.flatten().to_numpy().reshape(-1, dim)
        return matrix(column.to_pylist())

    def dealt(df: DataFrame, each: int, apart: bool) -> DataFrame:
        """df with part: a number for about `each` rows that lie together; apart: of one leaf of the router, else of successive ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = route(router, rows_of(batch.column("v"))) if router and batch.num_rows else np.zeros(batch.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        routed = written(df.mapInArrow(run, "id long, v array<double>, row long, leaf long"))
        size = F.ceil(F.count(F.lit(1)) / each) if apart else F.count(F.lit(1))
        counts = routed.groupBy("leaf").agg(size.alias("size"))  # a row per leaf of the router
        before = F.sum("size").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        counts = counts.withColumn("first", before)
        place = F.col("first") + F.pmod(F.xxhash64("row"), F.col("size"))
        return routed.join(F.broadcast(counts), "leaf").withColumn("part", place if apart else F.floor(place / each))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        t = build(pdf["id"].to_numpy(np.int64), matrix(pdf["v"]))
        return pd.DataFrame({"shard": pdf["part"].iloc[:1], "tree": [packed(**t)], "centre": [t["centre"][0].tolist()], "radius": [t["radius"][0]]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"block": pdf["part"].iloc[:1], "queries": [packed(ids=pdf["id"].to_numpy(np.int64), vectors=matrix(pdf["v"]))]})

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "balls": [packed(shard=pdf["shard"].to_numpy(np.int64), centre=matrix(pdf["centre"]), radius=pdf["radius"].to_numpy(float))]})

    trees = written(dealt(v, SHARD_ROWS, True).groupBy("part").applyInPandas(tree, "shard long, tree binary, centre array<double>, radius double"))
    blocks = written(dealt(q, BLOCK_ROWS, False).groupBy("part").applyInPandas(block, "block long, queries binary"))
    balls = written(trees.select("shard", "centre", "radius", F.floor(F.col("shard") / CHUNK).alias("chunk")).groupBy("chunk").applyInPandas(chunk, "chunk long, balls binary"))
    chunks = balls.count()
    # The stated queries meet all balls, in blocks and chunks: a chunk is a few numbers for CHUNK * SHARD_ROWS vectors.
    met = lambda b: b.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, chunks - 1)).cast("long")))).join(balls, "chunk")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, qs, c in zip(*[batch.column(i) for i in range(3)], strict=True):
                qs, c = unpacked(qs.as_py()), unpacked(c.as_py())
                up = bounds(qs["vectors"], c["centre"], c["radius"])
                top = np.argsort(-up, axis=1, kind="stable")[:, :NEAREST]
                i = np.repeat(np.arange(len(top)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b.as_py())), pa.array(i), pa.array(c["shard"][top.ravel()]), pa.array(up[i, top.ravel()])], names=["block", "nth", "shard", "bound"])

    first = met(blocks).select("block", "queries", "balls").mapInArrow(nearest, "block long, nth long, shard long, bound double")
    by_bound = Window.partitionBy("block", "nth").orderBy(F.desc("bound"), "shard")
    first = written(first.withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= NEAREST))

    def searched(pairs: DataFrame) -> DataFrame:
        """(block, nth, query_id, vec_id, score) of pairs (block, shard, nths, floors): the queries at nths of a block in a shard."""

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for n, qs in zip(batch.column(2), batch.column(4), strict=True):
                    n, qs = np.array(n.as_py()), unpacked(qs.as_py())
                    out.append(packed(nth=n, ids=qs["ids"][n], vectors=qs["vectors"][n]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], names=["block", "shard", "floors", "queries"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, floors, qs, t in zip(*[batch.column(i) for i in range(4)], strict=True):
                    qs, t = unpacked(qs.as_py()), unpacked(t.as_py())
                    best, who = search(t, qs["ids"], qs["vectors"], k, np.array(floors.as_py(), dtype=float))
                    i, j = np.nonzero(best > -np.inf)
                    arrays = [pa.array(np.full(len(i), b.as_py())), pa.array(qs["nth"][i]), pa.array(qs["ids"][i]), pa.array(who[i, j]), pa.array(best[i, j].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["block", "nth", "query_id", "vec_id", "score"])

        sub = pairs.select("block", "shard", "nths", "floors").join(blocks, "block").mapInArrow(picked, "block long, shard long, floors array<double>, queries binary")
        return sub.join(trees.select("shard", "tree"), "shard").select("block", "floors", "queries", "tree").mapInArrow(run, "block long, nth long, query_id long, vec_id long, score long")

    by_score = Window.partitionBy("block", "nth").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    # The k-th score of each query so far; a rounded one could be too high for a tie.
    reached = lambda found: found.filter(F.col("rank") == k).select("block", "nth", (F.col("score") - F.abs("score") * MARGIN).alias("floor"))
    pairs = lambda rows: rows.groupBy("block", "shard").agg(F.sort_array(F.collect_list(F.struct("nth", "floor"))).alias("x")).select("block", "shard", F.col("x.nth").alias("nths"), F.col("x.floor").alias("floors"))
    none = F.lit(float("-inf"))
    found = written(best(searched(pairs(first.filter("place = 1").withColumn("floor", none)))))
    nearer = first.filter("place > 1").join(reached(found), ["block", "nth"], "left").withColumn("floor", F.coalesce("floor", none)).filter("bound >= floor")
    columns = ["block", "nth", "query_id", "vec_id", "score"]
    found = written(best(searched(pairs(nearer)).union(found.select(*columns))))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, qs, known, c in zip(*[batch.column(i) for i in range(4)], strict=True):
                qs, c = unpacked(qs.as_py()), unpacked(c.as_py())
                floor = np.full(len(qs["ids"]), -np.inf)
                may = np.ones((len(floor), len(c["shard"])), dtype=bool)
                for x in known.as_py() or ():
                    floor[x["nth"]] = x["floor"]
                    may[x["nth"]] &= ~np.isin(c["shard"], x["shards"])
                may &= bounds(qs["vectors"], c["centre"], c["radius"]) >= floor[:, None]
                hit = np.flatnonzero(may.any(axis=0))
                nths = [np.flatnonzero(may[:, j]) for j in hit]
                arrays = [pa.array(np.full(len(hit), b.as_py())), pa.array(c["shard"][hit]), pa.array(nths, pa.list_(pa.int64())), pa.array([floor[n] for n in nths], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "shard", "nths", "floors"])

    done = first.groupBy("block", "nth").agg(F.collect_list("shard").alias("shards")).join(reached(found), ["block", "nth"], "left")
    done = done.groupBy("block").agg(F.collect_list(F.struct("nth", F.coalesce("floor", none).alias("floor"), "shards")).alias("known"))
    rest = met(blocks.join(done, "block")).select("block", "queries", "known", "balls").mapInArrow(left, "block long, shard long, nths array<long>, floors array<double>")
    out = best(searched(rest).union(found.select(*columns)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
