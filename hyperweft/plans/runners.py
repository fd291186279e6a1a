"""Experiments: grids of summaries, query comparisons, scalability samples and choices among runs."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cocluster, influence, relational, seeds, summary
from ..sources import files


def _with_random(inc: DataFrame, seed: int, k: int = 5, l: int = 5, **_) -> tuple[DataFrame, DataFrame]:
    return cocluster.random_clusters(inc, "node_id", k, seed).withColumnRenamed("label", "rc"), cocluster.random_clusters(inc, "edge_id", l, seed + 1).withColumnRenamed("label", "cc")


#: Algorithms by name: (incidence, seed, options) -> node and edge clusters.
ALGORITHMS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {
    "storage": lambda inc, seed, **o: cocluster.search(inc, "storage", seed, **o)[:2],
    "coclus_lsh": lambda inc, seed, **o: cocluster.search(inc, "mdl", seed, **o)[:2],
    "gahgc": lambda inc, seed, **o: cocluster.gahgc(inc, seed=seed, **o),
    "dhcc": lambda inc, seed, **o: cocluster.dhcc(inc, seed=seed, **o)[:2],
    "tau": lambda inc, seed, **o: cocluster.tau_search(inc, seed=seed, **o)[:2],
    "random": _with_random,
}


def summarize(inc: DataFrame, algorithm: str, seed: int = 0, **options) -> DataFrame:
    """One row: algorithm, seed, seconds of clustering, and the summary's numbers."""
    began = time.time()
    nodes, edges = ALGORITHMS[algorithm](inc, seed, **options)
    row = summary.evaluate(inc, nodes, edges)
    return row.select(F.lit(algorithm).alias("algorithm"), F.lit(seed).alias("seed"), F.lit(time.time() - began).alias("seconds"), "*")


def grid(datasets: dict[str, DataFrame], algorithms: dict[str, dict], seeds: list[int]) -> DataFrame:
    """A row for each dataset, algorithm and seed; a run that fails has status 'error' and no numbers."""
    rows = []
    for name, inc in datasets.items():
        for algorithm, options in algorithms.items():
            for seed in seeds:
                try:
                    row = summarize(inc, algorithm, seed, **options).withColumn("status", F.lit("ok"))
                except ValueError:
                    row = inc.sparkSession.createDataFrame([(algorithm, seed, "error")], "algorithm string, seed int, status string")
                rows.append(row.withColumn("dataset", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def scalability_inputs(inc: DataFrame, fractions: tuple[float, ...], seed: int = 0) -> DataFrame:
    """Per fraction of the hyperedges: n, m, nnz, density and original cost of its nested sample."""

    def row(f: float) -> DataFrame:
        s = relational.nested_sample(inc, f, seed)
        r = s.agg(F.count_distinct("node_id").alias("n"), F.count_distinct("edge_id").alias("m"), F.count(F.lit(1)).alias("nnz"))
        return r.select(F.lit(f).alias("fraction"), "n", "m", "nnz", F.round(F.col("nnz") / (F.col("n") * F.col("m")), 9).alias("density"), (F.col("m") + F.col("nnz")).alias("original_cost"))

    return reduce(DataFrame.union, map(row, fractions))


def scalability(inc: DataFrame, fractions: tuple[float, ...], seeds_: list[int], **options) -> DataFrame:
    """Per fraction of the hyperedges and seed: the nested sample's numbers, seconds, merge rounds by side, cost, improvement (1 - cost / original) and status; a run that fails keeps its row."""
    rows = []
    for seed in seeds_:
        for f in fractions:
            s = relational.nested_sample(inc, f, seed)
            n, m, nnz = s.agg(F.count_distinct("node_id"), F.count_distinct("edge_id"), F.count(F.lit(1))).first()
            trace: list = []
            began = time.time()
            try:
                nodes, edges, _ = cocluster.search(s, "storage", seed, trace=trace, **options)
                seconds = time.time() - began
                cost = summary.evaluate(s, nodes, edges).first()["cost"]
                status = "ok"
            except ValueError as e:
                seconds, cost, status = time.time() - began, None, f"error: {e}"
            rounds = [sum(t[1] == side for t in trace) for side in ("columns", "rows")]
            rows.append((f, seed, n, m, nnz, nnz / (n * m), m + nnz, seconds, *rounds, cost, None if cost is None else 1 - cost / (m + nnz), status))
    return inc.sparkSession.createDataFrame(
        rows, "fraction double, seed long, n long, m long, nnz long, density double, original_cost long, seconds double, column_rounds long, row_rounds long, cost long, improvement double, status string"
    )


def aggregate_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: runs, mean and sample standard deviation (0 for one run) of the runs that are ok."""
    g = runs.filter("status = 'ok'").groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"))
    return g


def select_candidate(runs: DataFrame, wanted: int | None = None) -> DataFrame:
    """The best of the candidates that have a run for every (dataset, seed), of which `wanted` are expected: runs (candidate, dataset, seed, cost, original, seconds).

    Score: mean over datasets of the seeds' mean of cost / original; ties by mean seconds, then by candidate.
    """
    if wanted is None:
        wanted = runs.select("dataset", "seed").distinct().count()
    full = runs.groupBy("candidate").agg(F.count_distinct("dataset", "seed").alias("n")).filter(F.col("n") == wanted).select("candidate")
    per = runs.join(full, "candidate").groupBy("candidate", "dataset").agg(F.avg(F.col("cost") / F.col("original")).alias("s"), F.avg("seconds").alias("t"))
    per = per.groupBy("candidate").agg(F.round(F.avg("s"), 6).alias("score"), F.round(F.avg("t"), 6).alias("seconds"))
    return per.orderBy("score", "seconds", "candidate").limit(1)


def candidate_grid(spark, options: dict[str, list]) -> DataFrame:
    """A row per combination of the options' values, numbered in order."""
    names = list(options)
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(itertools.product(*options.values()))], "candidate long, " + ", ".join(f"{n} double" for n in names))


#: The settings that are tried, by algorithm: a compact list varies one setting of the first at a time
#: ("around") or a product of some; the full one is the product of all.
COMPACT = {
    "gahgc": {"base": {"alpha": 0.5, "length": 50, "n_walks": 50}, "around": {"alpha": [0.3, 0.5, 0.7], "length": [50, 100, 150], "n_walks": [50, 100, 200]}},
    "dhcc": {"product": {"neighbours": [2, 3, 5, 10], "both": [1.0, 10.0, 100.0, 1000.0]}},
}
FULL = {
    "gahgc": {"alpha": [0.3, 0.5, 0.7], "length": [50, 100, 150], "n_walks": [50, 100, 200]},
    "dhcc": {"neighbours": [*range(1, 11)], "node_weight": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0], "edge_weight": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]},
}


def candidates(algorithm: str, search: str = "compact") -> list[dict]:
    """The settings that a tuning run tries: compact or full; repeats, by canonical JSON, are left out."""
    if algorithm not in COMPACT or search not in ("compact", "full"):
        raise ValueError(f"no {search} settings of {algorithm}")
    product = lambda o: [dict(zip(o, x, strict=True)) for x in itertools.product(*o.values())]
    if search == "full":
        return product(FULL[algorithm])
    how = COMPACT[algorithm]
    if "product" in how:
        return [{"neighbours": x["neighbours"], "node_weight": x["both"], "edge_weight": x["both"]} for x in product(how["product"])]
    return different([how["base"], *[{**how["base"], k: v} for k, values in how["around"].items() for v in values]])


def different(options: list[dict]) -> list[dict]:
    """Options without repeats, by their canonical JSON, in order."""
    return list({json.dumps(x, sort_keys=True): x for x in reversed(options)}.values())[::-1]


def tune(datasets: dict[str, DataFrame], algorithm: str, options: list[dict], seeds_: list[int], path: str, **fixed) -> tuple[DataFrame, DataFrame]:
    """(runs, best): each candidate on each dataset with each seed, kept at path a row at a time; what is there already isn't run again.

    best is select_candidate() of the runs that are ok, with its options as JSON.
    """
    spark = next(iter(datasets.values())).sparkSession
    schema = "dataset string, algorithm string, candidate long, options string, seed long, cost long, original long, seconds double, status string"
    wanted = [(d, i, s) for d in datasets for i in range(len(options)) for s in seeds_]
    files.append_result(spark.createDataFrame([], schema), path)
    done = {(r["dataset"], r["candidate"], r["seed"]) for r in spark.read.schema(schema).parquet(path).filter("status = 'ok'").select("dataset", "candidate", "seed").collect()}
    for d, i, s in wanted:
        if (d, i, s) in done:
            continue
        try:
            r = summarize(datasets[d], algorithm, s, **fixed, **options[i]).first()
            row = (r["cost"], r["original_cost"], r["seconds"], "ok")
        except ValueError as e:
            row = (None, None, None, f"error: {e}")
        files.append_result(spark.createDataFrame([(d, algorithm, i, json.dumps(options[i], sort_keys=True), s, *row)], schema), path)
    runs = spark.read.schema(schema).parquet(path)
    best = select_candidate(runs.filter("status = 'ok'"), len(datasets) * len(seeds_))
    return runs, best.join(runs.select("candidate", "options").distinct(), "candidate")


def influence_run(inc: DataFrame, most: int, seed: int = 0, original: DataFrame | None = None, nodes: DataFrame | None = None, model: str = "sicp", sims: int = 100, hops: int = 5, least: int = 1, **options) -> DataFrame:
    """Seed sets by seeds.search(), a row each: kind (archive or population), id, seeds, share of nodes that are seeds and are influenced, in percent.

    On a summary, inc is that of its superedges over supernodes, and the archive's sets are then upscaled to nodes
    (node_id, rc) of the original incidence, and simulated there: mean and standard deviation of the share influenced.
    """
    spark, began = inc.sparkSession, time.time()
    n = inc.select("node_id").distinct().count()
    found, last, history = seeds.search(inc, most, model, sims=sims, hops=hops, seed=seed, least=least, **options)
    attempts = history.agg(F.sum("attempts")).first()[0]
    numbers = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "seeds", (100 * F.col("size") / n).alias("seed_percent"), (100 * F.col("f1")).alias("influenced_percent"))
    out = numbers(found, "archive").union(numbers(last, "population"))
    if original is not None:
        rows, size = [], original.select("node_id").distinct().count()
        weights = relational.hyperdegree(original)
        spread = {"p_min": options.get("p_min", 0.005), "p_max": options.get("p_max", 0.02)} if model == "sicp" else {}
        for r in found.orderBy("id").collect():
            chosen = spark.createDataFrame([(int(x),) for x in r["seeds"].split(",")], "rc long")
            up = influence.upscale(chosen, nodes, weights, min(most, size))
            picked = [x["node_id"] for x in up.orderBy("order").collect()]
            start = up.select("node_id")
            if model == "lt":
                mean, std = influence.linear_threshold(original, start, options.get("threshold", 0.5), hops).count(), 0.0
            else:
                mean, std, _ = influence.simulation_stats(seeds.MODELS[model](original, start, sims, hops, seed=seed, **spread)).first()
            rows.append(("upscaled", r["id"], ",".join(map(str, picked)), 100 * len(picked) / size, 100 * mean / size, 100 * std / size))
        more = spark.createDataFrame(rows, "kind string, id long, seeds string, seed_percent double, influenced_percent double, influenced_std double")
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumns({"seed": F.lit(seed), "seconds": F.lit(time.time() - began), "attempts": F.lit(attempts)})


def synthetic(spark, sizes: list[tuple[int, int, int, float]], algorithms: dict[str, dict], seeds_: list[int]) -> DataFrame:
    """A row for each planted hypergraph (m, p, copies, noise), algorithm and seed: cost, the planted summary's cost, and increase ((cost - planted) / cost)."""
    rows = []
    for m, p, copies, noise in sizes:
        for seed in seeds_:
            inc, nodes, edges = planted(spark, m, p, copies, noise, seed)
            best = summary.evaluate(inc, nodes, edges).first()["cost"]
            for algorithm, options in algorithms.items():
                cost = summarize(inc, algorithm, seed, **options).first()["cost"]
                rows.append((m, p, copies, noise, algorithm, seed, cost, best, (cost - best) / cost))
    return spark.createDataFrame(rows, "m long, p long, copies long, noise double, algorithm string, seed long, cost long, planted long, increase double")


def increase(found: DataFrame, planted: DataFrame, keys: list[str]) -> DataFrame:
    """found (keys, cost) with increase: (cost - planted cost) / cost."""
    return found.join(planted.withColumnRenamed("cost", "best"), keys).select(*keys, "cost", "best", F.round((F.col("cost") - F.col("best")) / F.col("cost"), 6).alias("increase"))


def planted(spark, m: int, p: int, copies: int, noise: float, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidence, node clusters, edge clusters) with m planted superedges of p supernodes of p nodes, each `copies` times, entries flipped at rate noise."""
    from ..operators.influence import uniform

    nodes = spark.range(m * p * p).select(F.col("id").alias("node_id"), F.floor(F.col("id") / p).alias("rc"))
    edges = spark.range(m * copies).select(F.col("id").alias("edge_id"), F.floor(F.col("id") / copies).alias("cc"))
    full = edges.join(nodes, F.floor(nodes["rc"] / p) == edges["cc"]).select("edge_id", "node_id")
    lost = full.filter(uniform(F.col("edge_id"), F.col("node_id"), F.lit(seed)) >= noise)
    # As many entries are put in at random places as are lost on average.
    extra = edges.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(max(1, p * p))))).filter(uniform(F.col("edge_id"), F.col("i"), F.lit(seed + 1)) < noise)
    extra = extra.select("edge_id", F.floor(uniform(F.col("edge_id"), F.col("i"), F.lit(seed + 2)) * (m * p * p)).alias("node_id"))
    return lost.union(extra).distinct(), nodes, edges


def planted_tensor(spark, sizes: tuple[int, ...], blocks: int, noise: float, seed: int = 0) -> DataFrame:
    """(i0, i1, ..., val): ones in `blocks` diagonal blocks of a tensor of these sizes, flipped at rate noise; zeros are left out."""
    from ..operators.influence import uniform

    cells = spark.range(1).select(*[F.explode(F.sequence(F.lit(0), F.lit(sizes[0] - 1))).alias("i0")])
    for d, n in enumerate(sizes[1:], 1):
        cells = cells.withColumn(f"i{d}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    homes = [F.floor(F.col(f"i{d}") * blocks / n) for d, n in enumerate(sizes)]
    inside = reduce(lambda a, b: a & b, [homes[0] == h for h in homes[1:]])
    flip = uniform(*[F.col(f"i{d}") for d in range(len(sizes))], F.lit(seed)) < noise
    return cells.filter(inside != flip).withColumn("val", F.lit(1.0))
