"""Experiments from the command line: python -m hyperweft.plans.cli COMMAND --config FILE... [--set KEY=VALUE...]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from ..operators import summary
from ..sources import files
from . import runners


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["summarize", "tune", "scalability", "influence"])
    p.add_argument("--config", nargs="+", required=True, help="JSON files, the later over the earlier")
    p.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE", help="over the files; values are JSON, or text")
    p.add_argument("--deep", action="store_true", help="merge files deeply")
    return p


def options(args: list[str]) -> tuple[str, dict]:
    """The command and its settings."""
    a = parser().parse_args(args)
    out = files.load_config(*a.config, deep=a.deep)
    for x in a.set:
        key, _, value = x.partition("=")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return a.command, out


def run(spark: SparkSession, command: str, o: dict) -> DataFrame:
    """The command's rows, which are also written to o["out"]. datasets: name -> text file with a hyperedge per line."""
    read = lambda path: files.read_hyperedges(spark, path, o.get("sep", ","), files.flag(o.get("weighted", False)))[0]
    data, seeds = {name: read(path) for name, path in o["datasets"].items()}, o.get("seeds", [0])
    if command == "summarize":
        out = runners.grid(data, o["algorithms"], seeds)
    elif command == "tune":
        candidates = o.get("candidates") or runners.candidates(o["algorithm"], o.get("search", "compact"))
        out = runners.tune(data, o["algorithm"], candidates, seeds, o["runs"], **o.get("fixed", {}))[1]
    elif command == "scalability":
        out = runners.scalability(next(iter(data.values())), tuple(o.get("fractions", (0.2, 0.4, 0.6, 0.8, 1.0))), seeds, **o.get("fixed", {}))
    else:
        inc, extra = next(iter(data.values())), {}
        if o.get("algorithm"):
            nodes, edges = runners.ALGORITHMS[o["algorithm"]](inc, seeds[0], **o.get("fixed", {}))
            extra = {"original": inc, "nodes": nodes}
            inc, _ = summary.as_hypergraph(summary.block_counts(inc, nodes, edges), edges)
        out = runners.influence_run(inc, o.get("max_seed_nodes", 50), seeds[0], **extra, **o.get("search", {}))
    if o.get("out"):
        files.write_result(out, o["out"], o.get("kind", "csv"))
    return out


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), *options(sys.argv[1:])).show(truncate=False)
