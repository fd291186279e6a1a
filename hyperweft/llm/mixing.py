"""Operator 4: mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words, shielded, written

#: Blocks of all sources together, beside one for each source: larger corpora have larger blocks. They bound the table of
#: draws; no task holds a block's documents but where one is cut.
MOST_BLOCKS = 1 << 14


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with target: weights repeat over the sources by code point, null last.

    Targets share `share` of all sizes by weight and stop at `most` times their source's size; the excess is reshared by
    weight until none is above. That ends where target = min(most * size, level * weight); the level follows from
    running sums over the sources by most * size / weight. One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    up_to, whole = by_ratio.rowsBetween(Window.unboundedPreceding, 0), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "before": F.sum("cap").over(up_to) - F.col("cap"),
            "beyond": F.sum("weight").over(whole) - F.sum("weight").over(up_to) + F.col("weight"),
            "wanted": share * F.sum(F.col("source_size").cast("double")).over(whole),
        }
    )
    # The level that would hold if this source were the first below its cap; the least that is not above its own ratio is right.
    s = s.withColumn("level", (F.col("wanted") - F.col("before")) / F.col("beyond"))
    right = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("before", "level"))).over(whole)["level"]
    s = s.withColumn("level", right)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def split_blocks(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[s] blocks of source s, split over the shards: row h has how many of each source shard h gets.

    Each node of a binary tree over the shards gives its left half as many blocks as its share of shards, and draws from
    the multivariate hypergeometric distribution of which sources these are: quotas are kept exactly, and the shards'
    totals differ by at most one per level.
    """
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    draw = rng.multivariate_hypergeometric(quotas, round(total * left / shards), method="marginals")
    return np.vstack([split_blocks(draw, left, rng), split_blocks(quotas - draw, shards - left, rng)])


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """docs with place (the hash that orders a block), size (words) and key (of the source) added."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return docs.withColumns({"place": F.xxhash64("doc_id", "text", "source", F.lit(seed)), "size": n_words(F.col("text")), "key": key})


def _blocked(measured: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """measured with the block of its source that each row is in."""
    return measured.join(sources, "key").withColumn("block", F.pmod(F.xxhash64("place", F.lit(seed + 1)), F.col("blocks")))


def _plan(measured: DataFrame, weights: tuple[float, ...], share: float, most: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, plan) of measured rows (key, source, place, size).

    sources: key, blocks, source_size, target. plan, for each block that is drawn: key, block, draws (round, shard, cut),
    and for the block that a source's last draw cuts, the place of the document at which it is cut and the words that are
    left for it. A source's draws run through its blocks in a permuted order, round after round, until its target is
    reached; that number of draws is its quota, which the splitting tree parts among the shards, and each shard has the
    next ones of that order.
    """
    sizes = measured.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes.drop("key"), weights, share, most).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    targets = written(targets.select("key", "source_size", "target"))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    words = max(1, -(-total // MOST_BLOCKS))
    sources = targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).cast("long"))
    blocked = _blocked(measured.select("key", "place", "size"), sources, seed)
    blocks = blocked.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")).filter("words > 0")
    n_rows = measured.count()
    wanted = F.round("target").cast("long")
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(seed + 2)), "block")
    b = blocks.withColumns({"nth": F.row_number().over(order) - 1, "held": F.count(F.lit(1)).over(Window.partitionBy("key")), "before": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")})
    b = b.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    start = F.col("round") * F.col("source_size") + F.col("before")
    b = b.withColumns({"at": F.col("round") * F.col("held") + F.col("nth"), "left": wanted - start}).filter("left > 0")
    drawn = written(b.select("key", "block", "round", "at", F.least("left", "words").alias("taken"), (F.col("left") < F.col("words")).alias("cut")), n_rows)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        per_shard = split_blocks(pdf["count"].to_numpy(dtype=np.int64), shards, np.random.default_rng(seed))
        return pd.DataFrame({"key": pdf["key"], "ends": list(np.cumsum(per_shard, axis=0).T)})

    ends = drawn.groupBy("key").count().groupBy().applyInPandas(tree, "key string, ends array<long>")
    homes = drawn.join(ends, "key").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    plan = homes.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("round", "shard", "cut"))).alias("homes"))
    # Where a block is cut: rows of equal place are repeats of one, which share what is left for them evenly.
    cuts = drawn.filter("cut").select("key", "block", "taken")
    rows = blocked.select("key", "block", "place", "size").join(cuts, ["key", "block"]).groupBy("key", "block", "place", "taken").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("up_to", F.sum("words").over(up)).filter("up_to > taken")
    rows = rows.groupBy("key", "block").agg(F.min_by(F.struct("place", F.floor((F.col("taken") - F.col("up_to") + F.col("words")) / F.col("n")).alias("words")), "place").alias("last"))
    return sources, written(plan.join(rows, ["key", "block"], "left"), n_rows)


def _drawn(measured: DataFrame, sources: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """measured with source_size, target and draws (shard, place, words) of each row, as the plan's blocks have them."""
    out = _blocked(measured, sources, seed).join(plan, ["key", "block"], "left")
    partly = F.when(F.col("place") < F.col("last.place"), F.col("size")).when(F.col("place") == F.col("last.place"), F.least("size", "last.words")).otherwise(0)
    draw = lambda h: F.struct(h["shard"].alias("shard"), F.xxhash64("place", h["round"], F.lit(seed + 3)).alias("place"), F.when(h["cut"], partly).otherwise(F.col("size")).cast("long").alias("words"))
    none = F.array().cast("array<struct<shard:int,place:bigint,words:bigint>>")
    return out.withColumn("draws", F.coalesce(F.filter(F.transform("homes", draw), lambda x: x["words"] > 0), none))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, shards: int = 32, seed: int = 7) -> DataFrame:
    """What a mix takes of each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, draws, place.

    size: words (null text: 0). draws: an array, one for each time that the document is drawn: output shard, place in that
    shard's order, words from its start; taken is the sum of these words. The splitting tree gives each shard its quota
    of blocks of each source, and the shard draws that many, apart from all others'; a draw's place is hashed from the
    document's own and the round, so that each shard is shuffled and repeats of a document lie apart. Sources keep
    rounded targets exactly, as the last block is cut at a document and that document at a word; only rows that repeat
    doc_id, text and source are taken alike, so that their number may be missing where the cut meets them. No document is
    drawn more than `most` times. Blocks, their order and documents in it are hashed from source, doc_id and text: reruns
    agree on any partitioning. A null source is a source of its own, sources without words get nothing, null ids and
    empty texts take part, and an empty table gives no rows. Other columns of docs are not read.
    """
    measured = written(_measured(docs.select("doc_id", "text", "source"), seed).drop("text"))
    sources, plan = _plan(measured, weights, share, most, shards, seed)
    out = _drawn(measured, sources, plan, seed)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", "place")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, shards: int = 32, seed: int = 7) -> DataFrame:
    """The mix itself: a row of docs' columns for each draw of mix(); a document that is drawn in part has its first words, single spaces between them.

    n_chars, if there is one, is that of the words drawn; all other columns are unchanged, whatever their names. Rows are
    laid out by output shard and, within it, by place: ranges of both, so that no task holds a whole shard.
    """
    sources, plan = _plan(written(_measured(docs.select("doc_id", "text", "source"), seed).select("key", "source", "place", "size")), weights, share, most, shards, seed)
    rows, columns = shielded(docs)
    m = _drawn(_measured(rows.withColumns({c: _of(rows, docs, c) for c in ("doc_id", "text", "source")}), seed), sources, plan, seed)
    m = m.select(*rows.columns, "text", "size", F.explode("draws").alias("draw"))
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    text = F.when(F.col("draw.words") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("draw.words").cast("int")), " ")).otherwise(F.col("text"))
    m = m.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).orderBy("draw.shard", "draw.place")
    return m.select(*[F.col(c) if c in ("text", "n_chars") else x for c, x in zip(docs.columns, columns, strict=True)])


def _of(rows: DataFrame, docs: DataFrame, name: str) -> Column:
    """The shielded column of a name."""
    return rows[docs.columns.index(name)]
