"""Operator 2: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, written

#: Groups that one task differences, and partial partitions that one task combines.
CELL_GROUPS = 20_000
FAN_IN = 256
#: Documents of a block in which slots are counted one by one.
SLOT_ROWS = 50_000


def difference(partials: list[tuple[int, ...]]) -> tuple[tuple[int, ...], list[list[int]]]:
    """Combines partial partitions (k sums each) until one is left: its sums, and the final part of each part of each input.

    The two partials of largest spread are joined again and again, the larger sums of one with the smaller of the other.
    Inputs of the same spread go by their order.
    """
    k = len(partials[0])
    nodes, children, heap = [], {}, []
    for i, p in enumerate(partials):
        order = sorted(range(k), key=lambda j: -p[j]) if any(p[j] < p[j + 1] for j in range(k - 1)) else list(range(k))
        sums = [p[j] for j in order]
        nodes.append(order)  # the place after sorting -> the part it was
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    n = len(partials)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [u + v for u, v in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums = [sums[j] for j in order]
        children[n] = a, b, order
        heapq.heappush(heap, (sums[-1] - sums[0], n, sums))
        n += 1
    _, top, sums = heap[0]
    homes: dict[int, list[int]] = {top: list(range(k))}  # the final part of each place
    for node in range(n - 1, len(partials) - 1, -1):
        a, b, order = children[node]
        at, mine = homes.pop(node), [0] * k
        for place, j in enumerate(order):
            mine[j] = at[place]
        homes[a], homes[b] = mine, mine[::-1]
    final = []
    for i, order in enumerate(nodes):
        parts = [0] * k
        for place, j in enumerate(order):
            parts[j] = homes[i][place]
        final.append(parts)
    return tuple(sums), final


def _combine(cells: DataFrame, k: int) -> DataFrame:
    """cells (cell, sums) -> (cell, parts): the shard of each part of each cell. Levels of FAN_IN cells, a task each."""
    n = cells.count()
    groups = parts_for(n, FAN_IN)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        sums, parts = difference([tuple(map(int, s)) for s in pdf["sums"]])
        out = pd.DataFrame({"cell": pdf["cell"], "up": pdf["up"], "parts": parts})
        whole = pd.DataFrame({"cell": [-1], "up": pdf["up"].iloc[:1], "parts": [list(sums)]})
        return pd.concat([out, whole])

    up = written(cells.withColumn("up", F.pmod("cell", F.lit(groups))).groupBy("up").applyInPandas(one, "cell long, up long, parts array<long>"))
    below = up.filter("cell >= 0")
    if groups == 1:
        return below.select("cell", "parts")
    above = _combine(up.filter("cell < 0").select(F.col("up").alias("cell"), F.col("parts").alias("sums")), k)
    above = above.select(F.col("cell").alias("up"), F.col("parts").alias("to"))
    return below.join(above, "up").select("cell", F.transform("parts", lambda p: F.get("to", p.cast("int"))).alias("parts"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Puts every row of docs (doc_id, text) into one of `shards` shards of near equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null text: that of the empty one),
    law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null: this law promises nothing about
    one more shard). Null texts form one group, apart from empty ones; repeated rows each get a slot; slots follow the
    order in which rows are read, shards only the texts; an empty table gives no rows. Other columns of docs are not read. Tasks difference cells of about CELL_GROUPS groups, then the cells'
    partial partitions are differenced FAN_IN at a time. Copies are summed before the shuffle, so a group of any number
    of rows is one row there.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n")), 256)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    n = groups.count()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], ascending=[False, True])
        sums, parts = difference([(int(w), *[0] * (shards - 1)) for w in pdf["weight"]])
        out = pd.DataFrame({"cell": pdf["cell"], "key": pdf["key"], "part": [p[0] for p in parts], "sums": None})
        return pd.concat([out, pd.DataFrame({"cell": pdf["cell"].iloc[:1], "key": [None], "part": [-1], "sums": [sorted(sums, reverse=True)]})])

    cells = groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(parts_for(n, CELL_GROUPS))))
    cells = written(cells.groupBy("cell").applyInPandas(cell, "cell long, key binary, part int, sums array<long>"))
    homes = _combine(cells.filter("part < 0").select("cell", "sums"), shards)
    homes = written(cells.filter("part >= 0").join(homes, "cell").select("key", F.get("parts", F.col("part")).cast("int").alias("shard")))
    # Blocks are of rows, not of texts: copies and repeated rows lie in all of them.
    placed = rows.join(homes, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts_for(rows.count(), SLOT_ROWS))))
    # Slots: rows are numbered within (shard, block), and the shard's blocks before are counted.
    counts = placed.groupBy("shard", "block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    counts = counts.select("shard", "block", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return (
        placed.withColumn("nth", nth)
        .join(counts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
