"""Golden values on a hypergraph of 19 hyperedges over 12 nodes."""

import pytest

from hyperweft.operators import influence, metrics, rank, relational, summary, traverse
from hyperweft.sources import files

TOY = """1 2 3 4 5 6|1 2 4 5|2 3 4 5|1 2 3 4 5|1 4 5 7 0|1 2 3 6 7 0 10 11|1 2 3 6 7 10 11|2 3 6 7 10 11|1 2 6 7 8 10 11|2 3 6 7 9 10 11|1 2 6 7 10 11|6 7 8 9 0|4 6 7 8 9|4 5 6 7 9 0|6 8 9 0|8 9 0|2 8 9 0|3 7 8 9|6 7 0"""
ROWS = [(e, int(v)) for e, x in enumerate(TOY.split("|")) for v in x.split()]
RC = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3, 9: 3, 0: 3, 10: 4, 11: 4}
CC = {e: 0 if e < 5 else 1 if e < 11 else 2 for e in range(19)}


@pytest.fixture(scope="module")
def inc(spark):
    return spark.createDataFrame(ROWS, "edge_id long, node_id long").cache()


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame(list(RC.items()), "node_id long, rc long"), spark.createDataFrame(list(CC.items()), "edge_id long, cc long")


def by_node(df, column="value"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["node_id"])]


def test_degrees(inc):
    assert by_node(relational.hyperdegree(inc)) == [8, 8, 11, 8, 7, 6, 12, 12, 7, 8, 6, 6]
    assert by_node(relational.degree(inc)) == [11, 10, 11, 11, 9, 8, 11, 11, 10, 10, 9, 9]


def test_projections(inc):
    clique = {(r["src"], r["dst"]): r["w"] for r in relational.clique_projection(inc).collect()}
    assert len(clique) == 60 and sum(clique.values()) == 227 and clique[1, 2] == 7 and clique[6, 7] == 10
    assert relational.line_graph(inc).count() == 154


def test_closeness_and_hops(inc):
    nodes = inc.select("node_id").distinct()
    c = traverse.closeness(inc, nodes, 12)
    assert by_node(c, "dist_sum") == [11, 12, 11, 11, 13, 14, 11, 11, 12, 12, 13, 13]
    far = traverse.bfs(inc, nodes).filter("dist = 2").collect()
    assert {(r["src"], r["node"]) for r in far} == {(1, 9), (9, 1), (4, 10), (4, 11), (10, 4), (11, 4), (5, 8), (8, 5), (5, 10), (10, 5), (5, 11), (11, 5)}
    assert traverse.connected_components(inc).select("comp").distinct().collect()[0][0] == 0


def test_summary(inc, clusters):
    nodes, edges = clusters
    blocks = summary.block_counts(inc, nodes, edges)
    got = {(r["rc"], r["cc"]): r["dnz"] for r in blocks.collect()}
    rows = [[11, 14, 2], [10, 0, 3], [2, 12, 10], [1, 3, 19], [0, 12, 0]]
    assert got == {(i, j): z for i, row in enumerate(rows) for j, z in enumerate(row) if z}
    plus, minus = summary.corrections(inc, blocks, nodes, edges)
    assert (minus.count(), plus.count()) == (19, 11)
    assert summary.matrix_cost(blocks, edges).first()[0] == 40 and summary.original_cost(inc).first()[0] == 118
    assert summary.summary_cost(blocks, edges, plus, minus).first()["cost"] == 40
    assert summary.mismatches(inc, summary.decode(blocks, nodes, edges, plus, minus)).first()[0] == 0
    t = metrics.goodman_kruskal(blocks).first()
    assert (round(t["tau_x"], 6), round(t["tau_y"], 6)) == (0.177142, 0.376016)
    assert [round(r["tau"], 6) for r in metrics.tensor_tau(blocks, ["rc", "cc"], "dnz").orderBy("mode").collect()] == [0.376016, 0.177142]
    assert round(metrics.mdl_cost(blocks, nodes, edges).first()[0], 6) == 230.733142


def test_pagerank(inc):
    r = rank.graph_pagerank(inc, inc.select("node_id").distinct(), 20)
    want = ".069168 .087278 .111998 .085207 .065485 .057619 .121558 .119723 .059401 .069296 .076634 .076634"
    assert by_node(r, "rank") == pytest.approx([float(x) for x in want.split()], abs=1e-6)


@pytest.mark.parametrize(
    ("start", "steps", "want"),
    [
        (0, 1, ".15 .041741 .050595 .015179 .047812 .047812 .151533 .142679 .150521 .171771 .015179 .015179"),
        (0, 3, ".191431 .039935 .072917 .05013 .051653 .092005 .104598 .102979 .116159 .077898 .050148 .050148"),
        (5, 1, ".06375 .146389 .158194 .110972 .221944 .15 .056667 .06375 0 .028333 0 0"),
    ],
)
def test_diffusion(spark, inc, start, steps, want):
    ones = spark.createDataFrame([(e, 1) for e in range(19)], "edge_id long, weight long")
    x = {r["node_id"]: r["x"] for r in rank.diffusion(inc, ones, start, steps).collect()}
    assert [x.get(v, 0) for v in range(12)] == pytest.approx([float(v) for v in want.split()], abs=1e-6)


def test_edge_weights(inc, clusters):
    d = metrics.edge_distances(inc)
    got = {(r["edge_id"], r["node_id"]): r["dist"] for r in d.collect()}
    assert [round(got[0, v], 6) for v in (1, 2, 3, 4, 5, 6)] == [3.68, 4.16, 4.64, 4.64, 4.16, 8.48]
    w = {r["edge_id"]: r["weight"] for r in metrics.hyperedge_weights(d, 4.0).collect()}
    assert (round(w[0], 6), round(w[15], 6)) == (0.370486, 0.578607)
    labels = [r["label"] for r in metrics.dominant_label(inc, clusters[0]).orderBy("edge_id").collect()]
    assert labels == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 3, 2, 1, 3, 3, 3, 3, 2]


@pytest.mark.parametrize(("seeds", "threshold", "active"), [((8, 9), 0.5, 12), ((6, 7), 0.8, 2), ((8, 9, 0), 0.8, 3)])
def test_linear_threshold(spark, inc, seeds, threshold, active):
    s = spark.createDataFrame([(x,) for x in seeds], "node_id long")
    assert influence.linear_threshold(inc, s, threshold, 5).count() == active


def test_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("b,a,3\na,c,1\n\nb,b,2\n")
    inc, weights, nodes = files.read_hyperedges(spark, str(tmp_path / "h.csv"), weighted=True)
    key = {r["node_id"]: r["node_key"] for r in nodes.collect()}
    assert [key[i] for i in range(3)] == ["b", "a", "c"]
    assert sorted((r["edge_id"], key[r["node_id"]]) for r in inc.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "b")]
    assert [r["weight"] for r in weights.orderBy("edge_id").collect()] == [3, 1, 2]
    (tmp_path / "s.csv").write_text("V\na b\nc V\nV\nE\nC\nE\n0,2\n1,1\nC\n0\nc,\n,a\n")
    v, e, c = files.read_summary(spark, str(tmp_path / "s.csv"))
    assert sorted((r["sn_id"], r["node_key"]) for r in v.collect()) == [(0, "a"), (0, "b"), (1, "V"), (1, "c"), (2, "V"), (3, "E"), (4, "C")]
    assert [(r["members"], r["weight"]) for r in e.orderBy("se_id").collect()] == [("0", 2), ("1", 1)]
    assert sorted((r["se_id"], r["plus"], r["minus"]) for r in c.collect()) == [(0, "", "a"), (0, "c", "")]
    name = files.summary_name(data="x", algo="storage", run=1)
    assert files.parse_name(name) == {"data": "x", "algo": "storage", "run": "1"} and files.to_kib("1.5M") == 1536


def test_results_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/r"
    for n in (3, 5):
        files.write_result(spark.range(n), path, "parquet")
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r"]
    rows = files.trace_rows(spark, [(1, "columns", 20, 5, 0.1, -3.0, True)], dataset="x").collect()
    assert rows[0]["dataset"] == "x" and rows[0]["change"] == -3.0


def test_empty_incidence(spark):
    inc = spark.createDataFrame([], "edge_id long, node_id long")
    assert relational.hyperdegree(inc).count() == relational.degree(inc).count() == traverse.connected_components(inc).count() == 0
    assert relational.nested_sample(inc, 0.5).count() == 0
