"""Files of hypergraphs and summaries, and result files: readers and writers."""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import as_list, positions

#: Lines of a range in which the heads above lines are looked up.
RANGE = 100_000


def read_hyperedges(spark: SparkSession, path: str, sep: str = ",", weighted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidence, weights, nodes) of a text file with a hyperedge per line: nodes separated by sep, if weighted a whole
    number last. Nodes (node_id, node_key) are numbered as first seen; a node that repeats in a line counts once.
    """
    lines = _lines(spark, path).filter(F.trim("value") != "")
    edges = positions(lines, [F.col("file"), F.col("start"), F.col("id")], "edge_id")
    tokens = F.transform(F.split("value", re.escape(sep)), lambda x: F.trim(x))
    edges = edges.select("edge_id", tokens.alias("tokens"))
    last = F.element_at("tokens", -1)
    weights = edges.select("edge_id", (last.cast("long") if weighted else F.lit(1).cast("long")).alias("weight"))
    members = F.slice("tokens", F.lit(1), F.size("tokens") - 1) if weighted else F.col("tokens")
    each = edges.select("edge_id", F.posexplode(members).alias("pos", "node_key")).filter("node_key <> ''")
    firsts = each.groupBy("node_key").agg(F.min(F.struct("edge_id", "pos")).alias("first"))
    nodes = positions(firsts, [F.col("first")], "node_id").select("node_id", "node_key")
    return each.join(nodes, "node_key").select("edge_id", "node_id").distinct(), weights, nodes


def read_coordinates(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """An incidence (edge_id, node_id, value) from lines of row, column and value, counted from 1; '%' starts a comment, and the line of sizes is dropped."""
    t = F.split(F.trim("value"), re.escape(sep) + "+")
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = rows.agg(F.min("line")).first()[0]
    rows = rows.filter(F.col("line") != F.lit(first)) if first is not None else rows
    return rows.select((t[1].cast("long") - 1).alias("edge_id"), (t[0].cast("long") - 1).alias("node_id"), F.coalesce(F.get(t, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def summary_lines(nodes: DataFrame, consolidated: DataFrame, corrections: DataFrame) -> DataFrame:
    """(section, k, j, value): a summary's lines in order. nodes (node_id, rc), consolidated (se_id, members, weight),
    corrections (se_id, edge_id, plus, minus) with sorted comma-separated nodes; those without either are left out.
    Supernodes and superedges are numbered by their order, so members are rewritten to positions.
    """
    v = nodes.groupBy("rc").agg(as_list(F.collect_list("node_id")).alias("value"))
    v = positions(v, [F.col("rc")], "k")
    e = positions(consolidated, [F.col("se_id")], "k")
    m = e.withColumn("rc", F.explode_outer(F.when(F.col("members") != "", F.split("members", ",")))).withColumn("rc", F.col("rc").cast("long"))
    m = m.join(v.select("rc", F.col("k").alias("sn")), "rc", "left").groupBy("se_id", "k", "weight").agg(as_list(F.collect_list("sn")).alias("members"))
    ev = F.when(F.col("members") == "", F.col("weight").cast("string")).otherwise(F.concat_ws(",", "members", F.col("weight").cast("string")))
    c = corrections.filter("plus <> '' or minus <> ''").join(e.select("se_id", "k"), "se_id")
    body = F.concat_ws(",", F.translate("plus", ",", " "), F.translate("minus", ",", " "))
    heads = nodes.sparkSession.createDataFrame([("0V", "V"), ("2E", "E"), ("4C", "C")], "section string, value string")
    one = F.lit(-1).cast("long")
    out = heads.select("section", one.alias("k"), one.alias("j"), "value")
    out = out.union(v.select(F.lit("1v"), "k", one, F.translate("value", ",", " "))).union(m.select(F.lit("3e"), "k", one, ev))
    out = out.union(c.select(F.lit("5c"), "k", one, F.col("k").cast("string")).distinct())
    return out.union(c.select(F.lit("5c"), "k", F.col("edge_id").cast("long"), body))


def write_summary(lines: DataFrame, path: str) -> None:
    """Writes summary_lines() as a text folder whose parts, in name order, are the file."""
    lines.repartitionByRange("section", "k", "j").sortWithinPartitions("section", "k", "j").select("value").write.mode("errorifexists").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, id, value): lines, in the order of these; start is that of the part of the file that a task reads."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(supernodes (sn_id, node_key), superedges (se_id, members, weight), corrections (se_id, nth, plus, minus, weight)) of a summary file.

    Sections start at the first line that is just V, and at the last ones that are just E and C: nodes may be named so,
    and then be supernodes of their own. In section C a line without a comma names the superedge of those below.
    """
    lines = positions(_lines(spark, path), [F.col("file"), F.col("start"), F.col("id")], "line").select("line", "value")
    of = lambda x: F.when(F.col("value") == x, F.col("line"))
    v, e, c = lines.agg(F.min(of("V")), F.max(of("E")), F.max(of("C"))).first()
    section = lambda start, end: lines.filter((F.col("line") > start) & (F.col("line") < end)).withColumn("nth", F.col("line") - start - 1)
    supernodes = section(v, e).select(F.col("nth").alias("sn_id"), F.explode(F.split("value", " ")).alias("node_key"))
    t = section(e, c).withColumn("t", F.split("value", ","))
    superedges = t.select(F.col("nth").alias("se_id"), F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), ",").alias("members"), F.element_at("t", -1).try_cast("long").alias("weight"))
    rows = section(c, 2**62).withColumn("head", F.when(~F.col("value").contains(","), F.trim("value").try_cast("long")))
    # The head above a line: within ranges of lines, and, for those before a range's first one, the last of the ranges before.
    rows = rows.withColumn("range", F.floor(F.col("nth") / RANGE))
    up = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("range").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("nth"))).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ends.select("range", F.last("last", ignorenulls=True).over(before).alias("above"))
    rows = rows.join(ends, "range").withColumn("se_id", F.coalesce(F.last("head", ignorenulls=True).over(up), "above")).filter("head is null")
    t = F.split("value", ",")
    return supernodes, superedges, rows.select("se_id", "nth", t[0].alias("plus"), t[1].alias("minus"), F.coalesce(F.get(t, F.lit(2)).try_cast("long"), F.lit(1).cast("long")).alias("weight"))


def summary_name(**parts) -> str:
    """summary__key=value__... .csv; parse_name() reads it."""
    return "summary" + "".join(f"__{k}={v}" for k, v in parts.items()) + ".csv"


def parse_name(name: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in name.removesuffix(".csv").split("__")[1:])


#: KiB per unit.
UNITS = {"": 1 / 1024, "B": 1 / 1024, "K": 1, "M": 1024, "G": 1024**2, "T": 1024**3}


def to_kib(size: str) -> float:
    """KiB of a size like 12K or 1.5M."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([BKMGT]?)\s*", size)
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return float(m[1]) * UNITS[m[2]]


def size_kib(spark: SparkSession, path: str) -> float:
    """KiB of all files below path, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return (files.agg(F.sum("length")).first()[0] or 0) / 1024


def load_config(path: str, *more: str, deep: bool = False) -> dict:
    """JSON files, the later over the earlier: key by key, or deeply."""

    def over(a: dict, b: dict) -> dict:
        return {**a, **{k: over(a[k], v) if deep and isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    out: dict = {}
    for p in (path, *more):
        with open(p) as f:
            out = over(out, json.load(f))
    return out


def flag(value) -> bool:
    """A truth value that may be written as text."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes")


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Replaces path by df's rows: they are written beside it, and only whole results take its place."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    made, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.option("header", True).csv if kind == "csv" else w.parquet)(made)
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(made), at(path)):
        raise OSError(f"{made} didn't take the place of {path}")
    fs.delete(at(old), True)


def append_result(df: DataFrame, path: str) -> None:
    """Adds df's rows to the results at path; a run that fails midway adds none."""
    df.write.mode("append").parquet(path)


def trace_rows(spark: SparkSession, trace: list[tuple], **labels) -> DataFrame:
    """A search's trace as a table: (round, side, rows, bands, seconds, change, kept), and the labels of its run on each row."""
    out = spark.createDataFrame(trace, "round long, side string, rows long, bands long, seconds double, change double, kept boolean")
    return out.withColumns({k: F.lit(v) for k, v in labels.items()}) if labels else out


def run_log(name: str, path: str | None = None) -> logging.Logger:
    """A logger that writes time, level and message to the console, or to a file."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.FileHandler(path) if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def remaining(wanted: DataFrame, done: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The wanted runs of which no result is done yet."""
    return wanted.join(done, list(keys), "left_anti")
