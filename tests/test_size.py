"""Work that grows with the input, not with the square of a group."""

import random
import time
from collections import deque

import numpy as np
import pytest

from hyperweft.operators import cocluster, influence, metrics, rank, traverse
from hyperweft.plans import queries


def test_contact_in_one_large_hyperedge(spark):
    """Nodes that are all infected meet none: the pairs of 20,000 nodes in 5 simulations, 2 * 10^9, are never made."""
    n, began = 20_000, time.time()
    inc = spark.range(n).selectExpr("0L as edge_id", "id as node_id")
    got = influence.contact_process(inc, spark.createDataFrame([(0,)], "node_id long"), 5, 5, 1.0, 1.0).collect()
    assert sorted(map(tuple, got)) == [(i, n, n - 1) for i in range(5)]
    assert time.time() - began < 180


def test_distances_by_hyperedges(spark):
    """Both ways to count shared hyperedges agree; members of large hyperedges aren't met in pairs."""
    rng = random.Random(6)
    inc = spark.createDataFrame(sorted({(e, rng.randrange(40)) for e in range(12) for _ in range(15)}), "edge_id long, node_id long").cache()
    rows = lambda x: sorted(map(tuple, x.select("edge_id", "node_id", "dot").collect()))
    assert rows(metrics._dots_by_edges(inc)) == rows(metrics._dots_by_nodes(inc))
    large, began = spark.range(40_000).selectExpr("id % 2 as edge_id", "id div 2 as node_id"), time.time()
    assert metrics.edge_distances(large).filter("q = 20000").count() == 40_000
    assert time.time() - began < 120


def test_distances_by_matrix(spark, monkeypatch):
    """With few hyperedges, no join has a row per pair of a node's hyperedges, and distances are the same."""
    rng = random.Random(9)
    inc = spark.createDataFrame(sorted({(7 * e, rng.randrange(60)) for e in range(12) for _ in range(40)}), "edge_id long, node_id long").cache()
    want = sorted(map(tuple, metrics._dots_by_edges(inc).select("edge_id", "node_id", "dot").collect()))
    monkeypatch.setattr(metrics, "_dots_by_edges", None)
    monkeypatch.setattr(metrics, "_dots_by_nodes", None)
    assert metrics.edge_distances(inc).count() == inc.count()
    assert sorted(map(tuple, metrics._dots_by_matrix(inc).select("edge_id", "node_id", "dot").collect())) == want


@pytest.mark.parametrize("n", [40, 400])
def test_left_vectors(spark, n):
    """Singular vectors of a symmetric matrix, one value negative, with an empty row: by blocks and restarts as by a dense solver."""
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.standard_normal((n, 3)))[0]
    a = (u * [90, -70, 50]) @ u.T + np.where(rng.random((n, n)) < 0.05, rng.random((n, n)), 0)
    a = (a + a.T) / 2
    a[5] = a[:, 5] = 0
    rows = [(i, np.flatnonzero(a[i]).tolist(), a[i][a[i] != 0].tolist()) for i in range(n) if i != 5]
    got = cocluster.left_vectors(spark.createDataFrame(rows, "place long, at array<long>, x array<double>"), n, 3, tolerance=1e-9)
    want = np.linalg.svd(a)[0][:, :3]
    assert np.abs((got * want).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-6) and (got[5] == 0).all()


def test_neighbours_in_blocks(spark):
    """Nearest points over several blocks, copies by id; 12,000 points take seconds."""
    x = np.random.default_rng(7).integers(0, 3, (40, 4)).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    want = [(i, j, k + 1) for i in range(40) for k, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:5])]
    for block in (7, 64):
        assert sorted((r["vec_id"], r["neighbor_id"], r["rank"]) for r in metrics.knn_hypergraph(points, 5, block).collect()) == sorted(want)
    many = spark.range(12_000).selectExpr("id as vec_id", "transform(sequence(1, 8), k -> cast(pmod(xxhash64(id, k), 1000) as float)) as embedding")
    began = time.time()
    assert metrics.knn_hypergraph(many, 5).count() == 60_000
    assert time.time() - began < 60


def test_search_in_words(spark, monkeypatch):
    """130 sources are three words: no table of a search has a row per source and node, and distances are right."""
    rng, rows, cut = random.Random(5), [], traverse.cut
    inc = sorted({(e, rng.randrange(200)) for e in range(150) for _ in range(3)})

    def counted(df):
        df = cut(df)
        rows.append(df.count())
        return df

    monkeypatch.setattr(traverse, "cut", counted)
    got = traverse.bfs(spark.createDataFrame(inc, "edge_id long, node_id long"), spark.range(130).withColumnRenamed("id", "node_id")).collect()
    beside = {v: {w for e, u in inc if u == v for f, w in inc if f == e} for v in range(200)}
    want = {}
    for s in range(130):
        far, left = {s: 0}, deque([s])
        while left:
            v = left.popleft()
            for w in beside[v] - far.keys():
                far[w] = far[v] + 1
                left.append(w)
        want |= {(s, v): d for v, d in far.items()}
    assert {(r["src"], r["node"]): r["dist"] for r in got} == want and len(got) == len(want)
    assert max(rows) <= 3 * 200


@pytest.fixture(scope="module")
def apart(spark):
    """Ten components of 4 to 6 nodes and one of 90, which are two words, as incidence and as all distances."""
    rng = random.Random(8)
    rows = {(1000 * c + e, 1000 * c + v) for c in range(10) for e, v in [(i, i + j) for i in range(3 + c % 3) for j in (0, 1)]}
    rows |= {(20_000 + i, 20_000 + v) for i in range(90) for v in (i, (i + 1) % 90, rng.randrange(90))} | {(20_500, 20_000)}
    dist = {}
    nodes_of, edges_of = {}, {}
    for e, v in rows:
        nodes_of.setdefault(e, set()).add(v)
        edges_of.setdefault(v, set()).add(e)
    for s in edges_of:
        far, left = {s: 0}, deque([s])
        while left:
            v = left.popleft()
            for w in set().union(*(nodes_of[e] for e in edges_of[v])) - far.keys():
                far[w] = far[v] + 1
                left.append(w)
        dist |= {(s, v): d for v, d in far.items()}
    return spark.createDataFrame(sorted(rows), "edge_id long, node_id long").cache(), dist


#: Several parts, rows and steps; the largest component joined instead.
WAYS = [{"SMALL": 9, "STEP": 7, "WORDS": 1}, {"HELD": 100}]


@pytest.mark.parametrize("way", WAYS)
def test_closeness_of_all(spark, monkeypatch, apart, way):
    for name, value in way.items():
        monkeypatch.setattr(traverse, name, value)
    inc, dist = apart
    got = {r["node_id"]: (r["dist_sum"], r["reached"], r["closeness"]) for r in traverse.closeness_of_all(inc, 500).collect()}
    sums = {s: [d for (t, _), d in dist.items() if t == s] for s, _ in dist}
    assert got == {s: (sum(d), len(d) - 1, pytest.approx(499 / sum(d), abs=1e-6)) for s, d in sums.items()}


def test_closeness_query_of_all_nodes(spark):
    """The query returns every part that an order has, not a sample of them."""
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().count()
    got = queries.QUERIES["closeness"](spark, folder)
    assert parts > 100 and got.count() == parts
    assert "limit" not in queries.SQL["closeness"]


def test_khop_of_all(spark, monkeypatch, apart):
    """Pairs within two hops, over several parts, rows and steps."""
    for name, value in WAYS[0].items():
        monkeypatch.setattr(traverse, name, value)
    inc, dist = apart
    assert sorted(map(tuple, traverse.khop_of_all(inc, 2).collect())) == sorted(p for p, d in dist.items() if 1 <= d <= 2)


def test_khop_query_of_all_nodes(spark):
    """Every part is a source, not a sample of them."""
    parts = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count()
    assert parts > 100 and queries.QUERIES["khop_4"](spark, "/root/testdata/sf0.001").select("src").distinct().count() == parts
    assert "limit" not in queries.SQL["khop_4"]


def test_summary_hops_in_chunks(spark, monkeypatch):
    """Members of a supernode go in chunks, all of them, each once."""
    monkeypatch.setattr(traverse, "CHUNK", 4)
    superinc = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "edge_id long, node_id long")
    nodes = spark.range(30).selectExpr("id as node_id", "id % 3 as rc")
    got = sorted(map(tuple, traverse.khop_in_summary(superinc, nodes, nodes.select("node_id"), 1).collect()))
    assert got == sorted((a, b) for a in range(30) for b in range(30) if abs(a % 3 - b % 3) == 1)


def _diffused(inc, weight, seed, steps, teleport, cutoff, tie):
    """{node: x} by the definition, a hyperedge at a time."""
    members = {e: [v for f, v in inc if f == e] for e in weight}
    wd = {v: sum(weight[e] for e, u in inc if u == v) for _, v in inc}
    x = {seed: 1.0}
    for _ in range(steps):
        moved = {}
        for e, m in members.items():
            y = {v: x.get(v, 0) / wd[v] for v in m}
            hi, lo = max(y.values()), min(y.values())
            top, low = [v for v in m if y[v] > hi - tie], [v for v in m if y[v] < lo + tie]
            for v in m:
                moved[v] = moved.get(v, 0) + weight[e] * (hi - lo) * ((v in top) / len(top) - (v in low) / len(low))
        new = {v: x.get(v, 0) - (1 - teleport) * moved.get(v, 0) - teleport * (x.get(v, 0) - (v == seed)) for v in moved | x}
        x = {v: z for v, z in new.items() if z >= cutoff}
    return x


@pytest.mark.parametrize(("few", "blocks"), [(4_000_000, 16), (20, 1000), (5, 1000), (5, 0)])
def test_diffusion_in_blocks(spark, monkeypatch, few, blocks):
    """No table of a diffusion has a row per seed, hyperedge and node; values are right by blocks of seeds and by joins, ties near 0 too."""
    monkeypatch.setattr(rank, "FEW", few, raising=False)
    monkeypatch.setattr(rank, "BLOCKS", blocks, raising=False)
    rng, rows = random.Random(11), []
    inc = sorted({(e, rng.randrange(40)) for e in range(200) for _ in range(5)} | {(200, v) for v in range(60)} | {(201, 70)})
    weight = {e: 1 + e % 7 for e in range(202)}

    def counted(f):
        def run(df):
            df = f(df)
            rows.append(df.count())
            return df

        return run

    for name in ("cut", "stored"):
        monkeypatch.setattr(rank, name, counted(getattr(rank, name, lambda df: df)), raising=False)
    seeds = [0, 3, 17, 45, 70, 99]
    table = spark.createDataFrame(inc + inc[:50] * (blocks == 0), "edge_id long, node_id long")
    weights = spark.createDataFrame([*weight.items(), (300, None)], "edge_id long, weight long")
    got = rank.diffusions(table, weights, spark.createDataFrame([(s,) for s in seeds], "node_id long"), 3, 0.15, 1e-4, 1e-3).collect()
    want = {(s, v): x for s in seeds for v, x in _diffused(inc, weight, s, 3, 0.15, 1e-4, 1e-3).items()}
    assert {(r["seed"], r["node_id"]): r["x"] for r in got} == pytest.approx(want, abs=1e-12) and len(got) == len(want)
    assert max(rows) <= len(seeds) * 62
