"""Searches on the toy hypergraph and on planted ones."""

import random

import pytest
from pyspark.sql import functions as F

from hyperweft.operators import cocluster, metrics, rank, relational, seeds, summary
from hyperweft.plans import runners
from .test_toy import CC, RC, ROWS


@pytest.fixture(scope="module")
def inc(spark):
    return spark.createDataFrame(ROWS, "edge_id long, node_id long").cache()


@pytest.fixture(scope="module")
def nodes(inc):
    return seeds.Nodes(inc)


BESIDE = {v: {w for e, w in ROWS if (e, v) in ROWS} - {v} for _, v in ROWS}


def test_draws(nodes):
    """Nodes are drawn by weight, none that is held, and beside a gene only its neighbours."""
    rng = random.Random(1)
    got = nodes.draw([seeds.Ask("degree", rng.random(), (6, 7)) for _ in range(60)] + [seeds.Ask("1/hyperdegree", rng.random(), (5,), 5) for _ in range(60)] + [seeds.Ask("even", 0.5, tuple(range(12)))])
    assert set(got[:60]) <= set(range(12)) - {6, 7} and len(set(got[:60])) > 6
    assert set(got[60:120]) <= BESIDE[5] and got[120] is None
    assert nodes.n == 12 and nodes.weights((0, 6), "hyperdegree") == [8, 12]


@pytest.mark.parametrize("kind", ["mix", "random", "insert", "remove", "aware:1/degree:local:degree", "aware:mean_size:global:1/mean_size", "local_hyperdegree", "global_inverse_mean_size"])
def test_mutations(nodes, kind):
    rng = random.Random(2)
    before = [(1, 2), (3, 4, 5), (0,), (6, 7, 8, 9)]
    after = seeds.mutate(before, kind, nodes, 1, 4, rng)
    for a, b in zip(before, after):
        assert 1 <= len(b) <= 4 and len(set(b)) == len(b) and len(set(a) ^ set(b)) <= 2 and list(b) == sorted(b)
        if kind == "insert":
            assert len(b) == min(4, len(a) + 1)
        if kind == "remove":
            assert len(b) == max(1, len(a) - 1)
        if "local" in kind and set(b) - set(a):
            assert (set(b) - set(a)) <= set().union(*[BESIDE[x] for x in set(a) - set(b)])
    assert len(seeds.SINGLE) == 12


def test_selection():
    """Ranks, crowding and the archive, by brute force."""
    rng = random.Random(3)
    found = {(i,): (rng.randint(0, 9) / 10, rng.randint(0, 9) / 10) for i in range(60)}
    want = {c for c in found if not any(seeds.dominates(g, found[c]) for g in found.values())}
    assert set(seeds.archive(found)) == want == set(seeds.fronts(found)[0]) and sum(map(len, seeds.fronts(found))) == 60
    assert set(seeds.survivors(found, len(want))) == want and len(seeds.survivors(found, 40)) == 40
    cells = {(x / 10, y / 10) for x in range(10) for y in range(10) if any(f[0] > x / 10 and f[1] > y / 10 for f in found.values())}
    assert seeds.area(found.values()) == pytest.approx(len(cells) / 100)
    a, b = seeds.crossover((1, 2, 3, 4), (3, 4, 5, 6), rng, [])
    assert set(a) | set(b) == {1, 2, 3, 4, 5, 6} and {3, 4} <= set(a) & set(b)
    assert seeds.crossover((1, 2), (1, 2), rng, [])[0] == (1, 2)


def test_seed_search(inc):
    found, last, history = seeds.search(inc, 3, population=4, offspring=4, generations=1, sims=4, hops=2, mutation_kind="mix", p_min=0.2, p_max=0.6)
    h = [r["hypervolume"] for r in history.orderBy("generation").collect()]
    assert h == sorted(h) and len(h) == 2 and last.count() <= 4
    assert all(1 <= r["size"] <= 3 and r["f2"] == round((4 - r["size"]) / 3, 6) for r in found.collect())


def test_planted_clusters_are_found(spark):
    inc, nodes, edges = runners.planted(spark, 3, 3, 6, 0.0)
    best = summary.evaluate(inc, nodes, edges).first()["cost"]
    trace = []
    n, e, costs = cocluster.search(inc, "storage", max_rounds=1, last_bands=5, trace=trace)
    assert summary.evaluate(inc, n, e).first()["cost"] <= 1.1 * best and costs == sorted(costs, reverse=True) and {t[1] for t in trace} == {"columns", "rows"}


def test_tensor_moves(spark):
    """A planted tensor with few errors: moves don't lower the sum of taus; each start gives every item a cluster."""
    t = runners.planted_tensor(spark, (9, 6, 6), 3, 0.02).cache()
    modes = ["i0", "i1", "i2"]
    for start in ("random", "discrete", "centroids"):
        held = cocluster.tensor_start(t, modes, [3, 3, 3], 1, start)
        assert all(held[m].count() == t.select(m).distinct().count() for m in modes)
    held, (before, after), moves = cocluster.tensor_search(t, modes, [3, 3, 3], 1, max_iterations=1, per_mode=4)
    total = lambda x: x.agg(F.sum("tau")).first()[0]
    assert total(after) >= total(before) - 1e-9 and moves > 0


def test_icm(spark, inc):
    nodes = spark.createDataFrame(list(RC.items()), "node_id long, rc long")
    vectors = spark.createDataFrame([(v, [float(v % 3), float(v % 4)]) for v in RC], "node_id long, v array<double>")
    weights = spark.createDataFrame([(e, 1.0 + e % 2) for e in range(19)], "edge_id long, weight double")
    means = metrics.centers(vectors, nodes)
    mean = {c: [sum(x) / len(x) for x in zip(*[(v % 3, v % 4) for v in RC if RC[v] == c])] for c in set(RC.values())}
    members = {e: [v for x, v in ROWS if x == e] for e in range(19)}
    far = sum((v % 3 - mean[c][0]) ** 2 + (v % 4 - mean[c][1]) ** 2 for v, c in RC.items())
    apart = sum((1 + e % 2) * sum(RC[a] != RC[b] for i, a in enumerate(m) for b in m[i + 1 :]) for e, m in members.items())
    assert metrics.icm_objective(inc, vectors, nodes, means, weights, 0.5).first()[0] == pytest.approx(far + 0.5 * apart)
    for r in metrics.icm_move(inc, vectors, nodes, means, weights, 0.5).collect():
        v = r["node_id"]
        cost = {c: (v % 3 - m[0]) ** 2 + (v % 4 - m[1]) ** 2 + 0.5 * sum((1 + e % 2) * sum(RC[x] != c for x in ms if x != v) for e, ms in members.items() if v in ms) for c, m in mean.items()}
        assert r["label"] == min(cost, key=lambda c: (round(cost[c], 9), c))
    found, history = cocluster.icm(inc, vectors, weights, 5, start=nodes, max_iterations=1)
    assert all(a >= b - 1e-6 for a, b in zip(history, history[1:])) and found.select("rc").distinct().count() == 5


def test_ranks_from_many_seeds(spark, inc):
    """All seeds at once are as one by one; on a summary, nodes have their supernode's value."""
    ones = spark.createDataFrame([(e, 1) for e in range(19)], "edge_id long, weight long")
    x = rank.diffusions(inc, ones, spark.createDataFrame([(0,), (5,)], "node_id long"), 3)
    for s in (0, 5):
        assert {(r["node_id"], round(r["x"], 9)) for r in x.filter(f"seed = {s}").collect()} == {(r["node_id"], round(r["x"], 9)) for r in rank.diffusion(inc, ones, s, 3).collect()}
    nodes, edges = spark.createDataFrame(list(RC.items()), "node_id long, rc long"), spark.createDataFrame(list(CC.items()), "edge_id long, cc long")
    superinc, weights = summary.as_hypergraph(summary.block_counts(inc, nodes, edges), edges)
    y = rank.personalized_in_summary(superinc, weights, nodes, spark.createDataFrame([(1,)], "node_id long"), 5).collect()
    value = {r["node_id"]: r["x"] for r in y}
    assert all(len({value.get(v) for v in RC if RC[v] == c}) == 1 for c in set(RC.values())) and weights.agg(F.sum("weight")).first()[0] == 19


def test_tuning_resumes(spark, inc, tmp_path):
    assert [len(runners.candidates(a, s)) for a in ("gahgc", "dhcc") for s in ("compact", "full")] == [7, 27, 16, 490]
    assert runners.different([{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}]) == [{"a": 1, "b": 2}, {"a": 2}]
    options, path = [{"k": 2, "l": 2}, {"k": 99, "l": 2}], f"{tmp_path}/runs"
    for _ in range(2):
        runs, best = runners.tune({"toy": inc}, "random", options, [0], path)
        assert runs.count() == 2 and best.count() == 1
    with pytest.raises(ValueError):
        runners.candidates("random")


def test_positions(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = relational.positions(spark.createDataFrame(rows, "k long, i long").repartition(7), [F.col("k")]).collect()
    assert all(r["position"] == r["k"] for r in got)


def test_command_line(spark, tmp_path):
    import json

    from hyperweft.plans import cli

    (tmp_path / "h.txt").write_text("\n".join(",".join(str(v) for x, v in ROWS if x == e) for e in range(19)))
    (tmp_path / "c.json").write_text(json.dumps({"datasets": {"toy": str(tmp_path / "h.txt")}, "algorithms": {"random": {"k": 2, "l": 2}}, "out": f"{tmp_path}/out"}))
    command, o = cli.options(["summarize", "--config", str(tmp_path / "c.json"), "--set", "seeds=[0, 1]", "kind=parquet"])
    assert (command, o["seeds"], o["kind"]) == ("summarize", [0, 1], "parquet")
    cli.run(spark, command, o)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 2 and all(r["original_cost"] == 118 and r["status"] == "ok" for r in rows)


def test_readers(spark, tmp_path):
    from hyperweft.operators.relational import binary, drop_empty
    from hyperweft.sources import files

    (tmp_path / "m.mtx").write_text("% c\n3 4 3\n1 2 1\n3 4 2.5\n2 1 0\n")
    values = files.read_coordinates(spark, str(tmp_path / "m.mtx"))
    assert sorted((r["node_id"], r["edge_id"], r["value"]) for r in values.collect()) == [(0, 1, 1.0), (1, 0, 0.0), (2, 3, 2.5)]
    inc = binary(values)
    assert {tuple(r) for r in inc.select("node_id", "edge_id").collect()} == {(0, 1), (2, 3)}
    with pytest.raises(Exception, match="finite"):
        binary(spark.createDataFrame([(0, 0, float("nan"))], "edge_id long, node_id long, value double")).collect()
    edges, nodes = drop_empty(inc, spark.range(4).withColumnRenamed("id", "edge_id"), spark.range(3).withColumnRenamed("id", "node_id"))
    assert {r[0] for r in edges.collect()} == {1, 3} and {r[0] for r in nodes.collect()} == {0, 2}


def test_sparse_neighbours(spark, inc):
    sets = {v: {e for e, w in ROWS if w == v} for v in range(12)}
    rows = [(e, v) for e, v in ROWS] + [(90, 90), (91, 91), (92, 91)]
    sets |= {90: {90}, 91: {91, 92}}
    got = metrics.sparse_neighbours(spark.createDataFrame(rows, "edge_id long, node_id long"), 4).collect()
    for v in sets:
        want = sorted((len(sets[v] ^ sets[w]), w) for w in sets if w != v)[:4]
        assert sorted((r["rank"], r["d"], r["neighbor_id"]) for r in got if r["node_id"] == v) == [(i + 1, float(d), w) for i, (d, w) in enumerate(want)]


def test_smooth_factorization(spark):
    """A planted hypergraph without noise: the objective doesn't rise, and the planted clusters are found."""
    inc, nodes, _ = runners.planted(spark, 3, 2, 6, 0.0)
    n, e, objective = cocluster.dhcc(inc, 3, 3, iterations=4, node_weight=0.01, edge_weight=0.01)
    assert objective[-1] <= objective[0] + 1e-6
    blocks = {tuple(sorted(r["m"])) for r in n.groupBy("rc").agg(F.collect_list("node_id").alias("m")).collect()}
    assert blocks == {tuple(range(i, i + 4)) for i in (0, 4, 8)} and e.count() == 18
