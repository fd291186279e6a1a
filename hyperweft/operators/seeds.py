"""Seed sets of several sizes by a two-objective evolutionary search (NSGA-II): many influenced nodes from few seeds.

Candidates, tens of small sets, are the driver's. Nodes and links stay distributed: draws of nodes by weight and looks at
neighbours are asked for a generation at once, in one job each, and a generation's candidates are simulated in one job.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import influence

MODELS: dict[str, Callable[..., DataFrame]] = {"sicp": influence.contact_process, "wc": influence.weighted_cascade}
#: What nodes are weighed by, directly or inversely: hyperedges, neighbours, mean size of hyperedges.
MEASURES = ("hyperdegree", "degree", "mean_size")
WEIGHTS = ("even", *MEASURES, *[f"1/{m}" for m in MEASURES])
#: Ranges of hashed ids whose total weights the driver holds, to tell in which range a draw falls.
BUCKETS = 1024
#: The twelve mutations of one kind each: where the new node is from, and its weight.
SINGLE = {f"{place}_{'inverse_' if w.startswith('1/') else ''}{w.removeprefix('1/')}": (place, w) for place in ("local", "global") for w in WEIGHTS[1:]}
#: Most mutations that bring two parents apart before they are crossed.
RETRIES = 5

#: Nodes drawn by degree for a smart start, for each gene that a candidate may have.
POOL = 10

Candidate = tuple[int, ...]


class Ask(NamedTuple):
    """A node to be drawn: by weight, with u in [0, 1), none of held; of all nodes, or of those beside a gene."""

    weight: str
    u: float
    held: Candidate
    gene: int | None = None


class Nodes:
    """The nodes of an incidence with their weights, and the links between them, both distributed."""

    def __init__(self, inc: DataFrame):
        self.inc = cut(inc.select("edge_id", "node_id"))
        stats = influence.node_stats(self.inc).withColumn("even", F.lit(1.0))
        inverse = {f"1/{m}": F.when(F.col(m) > 0, 1 / F.col(m)).otherwise(0.0) for m in MEASURES}
        stats = stats.withColumns(inverse).withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int"))
        self.stats = cut(stats.select("node_id", "bucket", *[F.col(f"`{w}`").cast("double").alias(w) for w in WEIGHTS]))
        totals = self.stats.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{w}`")).alias(w) for w in WEIGHTS]).orderBy("bucket").collect()
        self.totals = {w: [(r["bucket"], r[w]) for r in totals] for w in WEIGHTS}
        self.n = sum(r["n"] for r in totals)
        self.known: dict[int, dict[str, float]] = {}

    def draw(self, asks: list[Ask]) -> list[int | None]:
        """The nodes asked for, in one job of each kind; None where no node is left. A node that is held gives way to the next one of its range."""
        spark, out = self.inc.sparkSession, [None] * len(asks)
        rows = []
        for i, a in enumerate(asks):
            if a.gene is None:
                at = a.u * sum(t for _, t in self.totals[a.weight])
                for bucket, t in self.totals[a.weight]:
                    if at < t:
                        break
                    at -= t
                if self.totals[a.weight]:
                    rows.append((i, a.weight, a.u, at, bucket, list(a.held), None))
            else:
                rows.append((i, a.weight, a.u, None, None, list(a.held), a.gene))
        if not rows:
            return out
        asked = spark.createDataFrame(rows, "ask long, weight string, u double, at double, bucket int, held array<long>, gene long")
        every = asked.filter("gene is null").join(self.stats, "bucket")
        # Beside a gene: the members of its hyperedges.
        genes = asked.filter("gene is not null").select(F.col("gene").alias("node_id")).distinct()
        edges = self.inc.join(F.broadcast(genes), "node_id").select(F.col("node_id").alias("gene"), "edge_id")
        beside = edges.join(self.inc, "edge_id").filter("node_id <> gene").select("gene", "node_id").distinct().join(self.stats.drop("bucket"), "node_id")
        near = asked.filter("gene is not null").drop("bucket").join(beside, "gene").withColumn("bucket", F.lit(-1))
        both = every.unionByName(near).filter(~F.array_contains("held", F.col("node_id")))
        chosen = F.coalesce(*[F.when(F.col("weight") == w, F.col(f"`{w}`")) for w in WEIGHTS])
        up = Window.partitionBy("ask").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("w", chosen).withColumns({"up_to": F.sum("w").over(up), "all": F.sum("w").over(Window.partitionBy("ask"))})
        # Of nodes without any weight, all are even; the last one stands for what lies beyond all.
        place = F.when(F.col("gene").isNull(), F.col("at")).otherwise(F.col("u") * F.col("all"))
        pick = both.groupBy("ask").agg(F.coalesce(F.min(F.when(F.col("up_to") > place, F.col("node_id"))), F.max("node_id")).alias("node_id"))
        found = pick.join(self.stats, "node_id").collect()
        for r in found:
            self.known[r["node_id"]] = {w: r[w] for w in WEIGHTS}
            out[r["ask"]] = r["node_id"]
        for i, a in enumerate(asks):  # a range whose nodes are all held: any other node
            if out[i] is None and a.gene is None and len(a.held) < self.n:
                rest = self.stats.filter(~F.col("node_id").isin(list(a.held)))
                out[i] = rest.agg(F.min_by("node_id", F.xxhash64("node_id", F.lit(a.u)))).first()[0]
                self.weights((out[i],), a.weight)
        return out

    def weights(self, genes: Candidate, weight: str) -> list[float]:
        missing = [g for g in genes if g not in self.known]
        if missing:
            for r in self.stats.filter(F.col("node_id").isin(missing)).collect():
                self.known[r["node_id"]] = {w: r[w] for w in WEIGHTS}
        return [self.known[g][weight] for g in genes]


def evaluate(inc: DataFrame, population: list[Candidate], n: int, model: str, sims: int, hops: int, **options) -> tuple[list[float], int]:
    """Mean share of nodes that each candidate influences, and the attempts of all; candidates and simulations in one job (threshold: one candidate at a time, it has no chance)."""
    spark = inc.sparkSession
    if model == "lt":
        out = []
        for c in population:
            seeds = spark.createDataFrame([(x,) for x in c], "node_id long")
            out.append(influence.linear_threshold(inc, seeds, options.get("threshold", 0.5), hops).count() / n)
        return out, 0
    rows = [(i, x) for i, c in enumerate(population) for x in c]
    found = MODELS[model](inc, spark.createDataFrame(rows, "cand long, node_id long"), sims, hops, **options)
    means = {r["cand"]: r for r in found.groupBy(F.floor(F.col("sim") / sims).alias("cand")).agg(F.avg("infected").alias("mean"), F.sum("attempts").alias("attempts")).collect()}
    return [means[i]["mean"] / n for i in range(len(population))], sum(r["attempts"] for r in means.values())


Fitness = tuple[float, float]


def dominates(a: Fitness, b: Fitness) -> bool:
    return a[0] >= b[0] and a[1] >= b[1] and a != b


def archive(found: dict[Candidate, Fitness]) -> dict[Candidate, Fitness]:
    """The candidates that no other dominates: a sweep by the first objective."""
    out, best = {}, None
    by_first: dict[float, list[Candidate]] = {}
    for c, f in found.items():
        by_first.setdefault(f[0], []).append(c)
    for x in sorted(by_first, reverse=True):
        top = max(found[c][1] for c in by_first[x])
        if best is None or top > best:
            best = top
            out |= {c: found[c] for c in by_first[x] if found[c][1] == top}
    return {c: f for c, f in found.items() if c in out}


def fronts(found: dict[Candidate, Fitness]) -> list[list[Candidate]]:
    """Candidates by rank: the non-dominated ones, then those that only these dominate, and so on."""
    rest, out = dict(found), []
    while rest:
        out.append(list(archive(rest)))
        for c in out[-1]:
            del rest[c]
    return out


def crowding(front: list[Candidate], found: dict[Candidate, Fitness]) -> dict[Candidate, float]:
    """How far each candidate's neighbours in its front are apart, over both objectives; the ends are infinitely far."""
    out = dict.fromkeys(front, 0.0)
    for k in (0, 1):
        order = sorted(front, key=lambda c: found[c][k])
        span = found[order[-1]][k] - found[order[0]][k]
        out[order[0]] = out[order[-1]] = float("inf")
        for a, c, b in zip(order, order[1:], order[2:], strict=False):
            out[c] += (found[b][k] - found[a][k]) / span if span else 0.0
    return out


def survivors(found: dict[Candidate, Fitness], size: int) -> list[Candidate]:
    """The `size` best by rank, of the last front the least crowded ones; in that order."""
    out: list[Candidate] = []
    for front in fronts(found):
        far = crowding(front, found)
        out += sorted(front, key=lambda c: -far[c])[: size - len(out)]
        if len(out) >= size:
            break
    return out


def initial(nodes: Nodes, size: int, least: int, most: int, rng: random.Random, strategy: str = "smart") -> list[Candidate]:
    """smart: half are drawn evenly, half by degree from a pool that is drawn by degree; degree: the first 1, 2, ... of high_degree_discount's seeds."""
    if strategy == "degree":
        picked = [r["node_id"] for r in influence.high_degree_discount(nodes.inc, most).orderBy("order").collect()]
        return [tuple(sorted(picked[:i])) for i in range(1, len(picked) + 1)]
    if strategy != "smart":
        raise ValueError(f"unknown strategy {strategy}")
    sizes = [rng.randint(least, most) for _ in range(2 * (size // 2))]
    pool = set(nodes.draw([Ask("degree", rng.random(), ()) for _ in range(POOL * most)]))
    ranked = sorted(x for x in pool if x is not None)
    even = nodes.draw([Ask("even", rng.random(), ()) for _ in range(2 * sum(sizes[::2]))])
    out = []
    for i, n in enumerate(sizes):
        if i % 2:
            left, held = list(ranked), []
            for _ in range(min(n, len(left))):
                held.append(rng.choices(left, [x + 1e-9 for x in nodes.weights(tuple(left), "degree")])[0])
                left.remove(held[-1])
            out.append(tuple(sorted(held)))
        else:
            out.append(tuple(sorted({x for x in (even.pop() for _ in range(n)) if x is not None})))
    return [c for c in dict.fromkeys(out) if c]


def crossover(a: Candidate, b: Candidate, rng: random.Random, spare: list[int]) -> tuple[Candidate, Candidate]:
    """One cut in each parent's own genes; common ones stay in both. Parents that differ in less than two genes first get new nodes, RETRIES times at most; then they go on as they are, exchanged."""
    for _ in range(RETRIES):
        if len(set(a) - set(b)) > 1:
            break
        a, b = (replaced(c, rng, spare) for c in (a, b))
    else:
        if len(set(a) - set(b)) < 2:
            return b, a
    common = set(a) & set(b)
    x, y = [v for v in a if v not in common], [v for v in b if v not in common]
    i = rng.randint(1, len(x) - 1)
    made = ({*common, *x[:i], *y[i:]}, {*common, *y[:i], *x[i:]})
    return tuple(tuple(sorted(m)) for m in made)


def replaced(c: Candidate, rng: random.Random, spare: list[int]) -> Candidate:
    """One gene replaced by a spare node, which were drawn evenly; a candidate of one gene stays."""
    if len(c) < 2:
        return c
    while spare:
        if (new := spare.pop()) not in c:
            return tuple(sorted({*c, new} - {rng.choice(c)}))
    return c


def mutation(kind: str, c: Candidate, nodes: Nodes, least: int, most: int, rng: random.Random) -> tuple[int | None, Ask | None]:
    """(gene that goes, node that is asked for) of a mutation of c.

    random, insert, remove; aware:<weight of the gene>:<local or global>:<weight of the node>; a name of SINGLE, which
    takes any gene; or mix, which draws among them. A set that is full or smallest has a gene replaced instead; a set of
    one gene is not replaced but grows, where it may.
    """
    u, any_gene = rng.random(), rng.choice(c)
    if kind == "mix":
        kind = "insert" if len(c) == 1 else rng.choice(["random", "insert", "remove", f"aware:1/degree:{rng.choice(['local', 'global'])}:degree"])
    if kind == "insert" and len(c) >= most or kind == "remove" and len(c) <= least:
        kind = "random"
    if kind == "insert":
        return None, Ask("even", u, c)
    if kind == "remove":
        return any_gene, None
    if kind == "random":
        return (any_gene, Ask("even", u, c)) if len(c) > 1 else (None, None)
    if kind.startswith("aware:"):
        _, gene_weight, place, weight = kind.split(":")
        w = nodes.weights(c, gene_weight)
        gene = rng.choices(c, w)[0] if sum(w) else any_gene
    else:
        (place, weight), gene = SINGLE[kind], any_gene
    return gene, Ask(weight, u, c, gene if place == "local" else None)


def mutate(candidates: list[Candidate], kind: str, nodes: Nodes, least: int, most: int, rng: random.Random) -> list[Candidate]:
    """All candidates mutated; a gene without other neighbours is replaced by any node."""
    plans = [mutation(kind, c, nodes, least, most, rng) for c in candidates]
    asks = [a for _, a in plans if a]
    drawn = dict(zip([i for i, (_, a) in enumerate(plans) if a], nodes.draw(asks), strict=True))
    missing = [i for i, x in drawn.items() if x is None]
    drawn |= dict(zip(missing, nodes.draw([Ask("even", rng.random(), candidates[i]) for i in missing]), strict=True))
    out = []
    for i, (c, (gene, ask)) in enumerate(zip(candidates, plans, strict=True)):
        new = drawn.get(i)
        if ask and new is None:
            out.append(c)
        else:
            out.append(tuple(sorted((set(c) - {gene}) | ({new} if ask else set()))))
    return out


def search(
    inc: DataFrame,
    most: int,
    model: str = "sicp",
    population: int = 10,
    offspring: int = 100,
    generations: int = 50,
    sims: int = 100,
    hops: int = 5,
    seed: int = 0,
    strategy: str = "smart",
    least: int = 1,
    tournament: int = 5,
    mutation_kind: str = "random",
    mutation_rate: float = 1.0,
    crossover_rate: float = 1.0,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archive, population, history): the non-dominated candidates found, the last generation, and a row per generation.

    archive and population: (id, seeds, size, f1, f2), f1 the share of influenced nodes, f2 (most + 1 - size) / most.
    history: (generation, evaluations, attempts, hypervolume of the archive). Parents are drawn by tournaments, by rank
    and then by crowding; a generation is the best of parents and offspring.
    """
    rng = random.Random(seed)
    nodes = Nodes(inc)
    most, least = min(most, nodes.n), min(least, nodes.n)
    if model == "sicp":
        options = {"p_min": 0.005, "p_max": 0.02} | options
    found: dict[Candidate, Fitness] = {}
    history, evaluations = [], 0

    def assess(new: list[Candidate], generation: int) -> None:
        nonlocal evaluations
        new = [c for c in dict.fromkeys(new) if c not in found]
        attempts = 0
        if new:
            means, attempts = evaluate(nodes.inc, new, nodes.n, model, sims, hops, **options)
            found.update({c: (m, (most + 1 - len(c)) / most) for c, m in zip(new, means, strict=True)})
        evaluations += len(new)
        history.append((generation, evaluations, attempts, area(archive(found).values())))

    alive = initial(nodes, population, least, most, rng, strategy)
    assess(alive, 0)
    for g in range(1, generations + 1):
        rank = {c: (i, -far) for i, f in enumerate(fronts({c: found[c] for c in alive})) for c, far in crowding(f, found).items()}
        spare = [x for x in nodes.draw([Ask("even", rng.random(), ()) for _ in range(2 * RETRIES * offspring)]) if x is not None]
        children: list[Candidate] = []
        while len(children) < offspring:
            a, b = (min(rng.choices(alive, k=tournament), key=rank.__getitem__) for _ in "ab")
            children += crossover(a, b, rng, spare) if rng.random() < crossover_rate else (a, b)
        changing = [rng.random() < mutation_rate for _ in children]
        mutated = iter(mutate([c for c, x in zip(children, changing, strict=True) if x], mutation_kind, nodes, least, most, rng))
        children = [next(mutated) if x else c for c, x in zip(children, changing, strict=True)]
        children = [c for c in children if least <= len(c) <= most]
        assess(children, g)
        alive = survivors({c: found[c] for c in dict.fromkeys([*alive, *children])}, population)
    spark = inc.sparkSession
    table = lambda cs: spark.createDataFrame([(i, ",".join(map(str, c)), len(c), round(found[c][0], 6), round(found[c][1], 6)) for i, c in enumerate(sorted(cs))], "id long, seeds string, size long, f1 double, f2 double")
    return table(archive(found)), table(alive), spark.createDataFrame(history, "generation long, evaluations long, attempts long, hypervolume double")


def area(points) -> float:
    """The area that points, to be maximized, dominate from (0, 0)."""
    out, top = 0.0, 0.0
    for x, y in sorted(points, reverse=True):
        if y > top:
            out += x * (y - top)
            top = y
    return round(out, 6)
