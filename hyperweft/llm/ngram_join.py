"""Operator 6: Jaccard self-join of documents on word n-grams, by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import EACH, fresh, written

SHINGLE = 5
#: Counters of the frequency sketch (a fixed size, whatever the corpus) and those in one chunk of it.
COUNTERS, CHUNK = 1 << 21, 1 << 16
#: Sketches that one task adds up at once.
FAN_IN = 64
#: Slots of the filter that keeps texts off the verification which are in no candidate pair; it may let others pass.
SLOTS = 1 << 24
#: Sets that are compared with one in a task.
MEMBERS = 64
#: Most shared tokens that a prefix asks for, and the cost of a verification in scanned postings.
MOST_MATCHES, VERIFY_COST = 6, 25.0
#: Rounds at most that look for homes, and the pairs per posting below which there is no need for another round. The
#: result doesn't depend on either.
ROUNDS, FEW_PAIRS = 3, 4
#: Members of a home in a block, and distinct tokens that a task holds at once, as blocks are compared.
BLOCK, COLUMNS = 512, 4096
#: Rows that a Python worker takes of an Arrow batch at once, and pairs of sets that are compared in a task.
PIECE, COMPARED = 256, 2000


def shingles(text: str | None) -> np.ndarray:
    """The distinct word n-grams of a text, A-Z lower-cased, as sorted 64-bit hashes; of fewer words, the one of all words; of none, none."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else ()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(words))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def buckets(x: np.ndarray, counters: int = COUNTERS) -> np.ndarray:
    return (x >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, PIECE at a time: what a worker makes of them is held for these only."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            yield batch.slice(i, PIECE)


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with one that is similar enough."""
    return -(-percent * n // 100)


def prefix(x: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int, float]:
    """(prefix, matches, score) of a set: its rarest tokens, by (count, token), and how many of them a similar set shares.

    A prefix of n - needed + m tokens has m in common with that of every similar set. m is chosen by estimated cost:
    postings to scan, and pairs to verify, of which those with m matches are at most a share 1/m. score: how common the
    set's tokens are.
    """
    n = len(x)
    c = counts[buckets(x)]
    order = np.lexsort((x, c))
    f = np.maximum(c - noise, 0.0) + 1.0
    least = n - needed(n, percent)
    most = min(MOST_MATCHES, needed(n, percent))
    scanned = np.cumsum(f[order])
    m = np.arange(1, most + 1)
    cost = scanned[least + m - 1] + VERIFY_COST * (scanned[least + m - 1] - (least + m)) / m
    matches = int(m[np.argmin(cost)])
    return x[order[: least + matches]], matches, float(np.log2(f).mean())


def _sums(parts: DataFrame) -> np.ndarray:
    """Adds up sketches (part, chunk, counts) FAN_IN at a time; the sum has COUNTERS numbers, the only thing that is collected."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in pdf["counts"])
        return pd.DataFrame({"part": pdf["up"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    n = parts.agg(F.max("part")).first()[0]
    while True:
        parts = parts.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("up", "chunk").applyInPandas(add, "part long, chunk int, counts binary")
        n = (n or 0) // FAN_IN
        if not n:
            break
        parts = written(parts)
    out = np.zeros(COUNTERS, dtype=np.int64)
    for x in parts.collect():
        out[x["chunk"] * CHUNK : (x["chunk"] + 1) * CHUNK] += np.frombuffer(zlib.decompress(x["counts"]), dtype=np.int64)
    return out


def profile(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, key, digest, n) of each document, and (part, chunk, counts) of each task's token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in pieces(batches):
            digests, sizes = [], []
            for t in batch.column(2):
                x = shingles(t.as_py())
                np.add.at(counts, buckets(x), 1)
                digests.append(digest(x))
                sizes.append(len(x))
            n = len(sizes)
            none = lambda kind: pa.nulls(n, kind)
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, none(pa.int64()), none(pa.int32()), none(pa.binary())], names=names)
        if counts.any():
            part, chunks = TaskContext.get().partitionId(), [c for c in range(COUNTERS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
            n = len(chunks)
            data = [zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in chunks]
            arrays = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(chunks, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "key", "digest", "n", "part", "chunk", "counts"]
    return written(docs.mapInArrow(run, "doc_id long, key binary, digest binary, n long, part long, chunk int, counts binary"))


def classes(docs: DataFrame, counts: np.ndarray, percent: int, n_docs: int) -> DataFrame:
    """A row per distinct non-empty set: cid, rep (smallest doc_id), digest, n, matches, score, tokens (prefix, in order)."""
    sc = docs.sparkSession.sparkContext
    sketch, noise = sc.broadcast(counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64)), float(np.median(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(x := shingles(t.as_py())):
                    tokens, matches, score = prefix(x, sketch.value, noise, percent)
                    out.append((d, digest(x), len(x), matches, score, tokens.view(np.int64)))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "digest", "n", "matches", "score", "tokens"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, matches int, score double, tokens array<long>")
    rows = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "matches", "score", "tokens")])
    return written(rows.select(F.monotonically_increasing_id().alias("cid"), "rep", "digest", "n", "matches", "score", "tokens"), n_docs)


def verify(pairs: DataFrame, n_pairs: int, docs: DataFrame, known: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """Of pairs (a, b, room) of cids those whose slack, by their whole sets, is -room at least: a, b, slack, size_a, size_b, shared, x.

    The slack of two sets is (100 + percent) * shared - percent * (size_a + size_b): they are similar if it isn't below 0.
    x is their symmetric difference, if `differences` asks for it. Compressed texts travel, which are smaller than sets:
    of each pair the class in fewer pairs goes to that in more, in parts of about MEMBERS, to which that one's text comes
    as well. Texts of documents that no pair concerns are passed over by a filter of SLOTS slots.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("deg"))
    of = lambda side: degree.select(F.col("cid").alias(side), F.col("deg").alias(f"deg_{side}"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("turn", (F.col("deg_a") > F.col("deg_b")) | ((F.col("deg_a") == F.col("deg_b")) & (F.col("a") > F.col("b"))))
    turned = turned.select(F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("cid"), "turn", "room")
    turned = written(turned, n_pairs)
    many = turned.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
    wanted = turned.join(many, "lead").select("lead", F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt"), "cid", "turn", "room", F.lit(None).cast("long").alias("salts"))
    wanted = wanted.union(many.select("lead", F.lit(0).cast("long").alias("salt"), F.col("lead").alias("cid"), F.lit(False).alias("turn"), F.lit(0).cast("long").alias("room"), "salts"))
    concerned = written(wanted.join(known.select("cid", "rep", "digest"), "cid"), 2 * n_pairs)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, dtype=bool)
        for batch in batches:
            held[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        all_bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"part": pdf["up"].iloc[:1], "bits": [zlib.compress(all_bits.tobytes(), 1)]})

    parts = concerned.select(slot(F.col("rep")).alias("slot")).distinct().mapInArrow(bits, "part long, bits binary")
    parts = parts.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("up").applyInPandas(union, "part long, bits binary")
    mask = np.zeros(SLOTS // 8, dtype=np.uint8)
    for x in parts.toLocalIterator():
        mask |= np.frombuffer(zlib.decompress(x["bits"]), dtype=np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(mask)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = batch.column(0).to_numpy()
            take = np.flatnonzero(held.value[s >> 3] >> (7 - (s & 7)) & 1)
            found = [t for i in take if (t := batch.column(1)[int(i)].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([digest(shingles(t)) for t in found], pa.binary()), pa.array([zlib.compress(t.encode(), 1) for t in found], pa.binary())], names=["digest", "text"])

    made = docs.select(slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(texts, "digest binary, text binary")
    made = made.groupBy("digest").agg(F.first("text").alias("text"))  # copies and repeated rows are one, before the shuffle
    # A lead's text is put beside each of its parts after the join only, so that its key is no hotter than others.
    each = F.explode(F.when(F.col("salts").isNull(), F.array("salt")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = made.join(concerned.drop("rep"), "digest").select("lead", each.alias("salt"), F.col("salts").isNotNull().alias("first"), "cid", "text", "turn", "room")
    met = met.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("first"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, dtype=np.uint64)  # the set of the part at hand; its row comes first
        for batch in pieces(batches):
            out = []
            for lead, first, cid, text, turn, room in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], batch.column(4), *[batch.column(i).to_pylist() for i in (5, 6)], strict=True):
                x = shingles(zlib.decompress(text.as_py()).decode())
                if first:
                    mine = x
                    continue
                shared = len(np.intersect1d(x, mine, assume_unique=True))
                slack = (100 + percent) * shared - percent * (len(x) + len(mine))
                if slack + room >= 0:
                    ends, sizes = (lead, cid)[:: 1 if turn else -1], (len(mine), len(x))[:: 1 if turn else -1]
                    out.append((*ends, slack, *sizes, shared, np.setxor1d(x, mine, assume_unique=True).view(np.int64) if differences else None))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "slack", "size_a", "size_b", "shared", "x"])

    return written(met.mapInArrow(compared, "a long, b long, slack long, size_a long, size_b long, shared long, x array<long>"), n_pairs, COMPARED)


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """(node, root) of all nodes of links (a, b), n_links if known: root is the component's smallest node. Alternating large and small stars, until nothing changes."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = written(links.select(high.alias("a"), low.alias("b")).filter("a <> b").distinct(), n_links)
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mins = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(mins.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, n_links)
        # Two 64-bit sums of hashes tell whether anything changed.
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen:
            break
        seen = mark
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def homes(postings: DataFrame, n_postings: int, docs: DataFrame, known: DataFrame, percent: int, differences: bool) -> DataFrame | None:
    """Members (cid, home, w, v, x): classes that are similar to one other, their home, which is no member itself. None: none.

    Near copies so become one item for all that follows. Each class is compared with one lead of its tokens: at first the
    class of the most common tokens, which a group's plainest text has; then, if at least half were similar to it, those
    without a home with any class that has none either or is one. w and v weigh how far a member is from its home (d tokens of the home lacking, e tokens
    beyond it): 100 d + percent e, percent d + 100 e. By the triangle inequality of counts, the slack of members a and b
    of homes of slack s lies between s - w_a - w_b and s + v_a + v_b.
    """
    found = None
    for i in range(ROUNDS):
        here = postings.select("token", "cid", "score")
        if found is not None:
            if 2 * hits < tries:  # what is left has none
                break
            here = written(here.join(found.select("cid"), "cid", "left_anti"), n_postings, 8 * EACH)
            n = here.groupBy("token").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
            if (n["pairs"] or 0) <= FEW_PAIRS * (n["rows"] or 0):
                break
        first = F.struct("score", "cid") if not i else F.struct(F.xxhash64("cid", F.lit(i)), "cid")
        leads = here.groupBy("token").agg(F.max_by("cid", first).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        tried = here.join(leads, "token").filter("cid <> lead")
        if found is not None:  # a home stays one
            tried = tried.join(found.select(F.col("home").alias("cid")).distinct(), "cid", "left_anti")
        tried = tried.groupBy("cid", "lead").agg(F.count(F.lit(1)).alias("n")).groupBy("cid").agg(F.max(F.struct("n", "lead")).alias("x"))
        tried = written(tried.select(F.col("cid").alias("a"), F.col("x.lead").alias("b"), F.lit(0).cast("long").alias("room")), n_postings, 8 * EACH)
        if not (tries := tried.count()):
            break
        links = verify(tried, tries, docs, known, percent, differences)
        hits = links.count()
        links = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        d, e = F.col("size_b") - F.col("shared"), F.col("size_a") - F.col("shared")
        links = links.select(F.col("a").alias("cid"), F.col("b").alias("home"), (100 * d + percent * e).alias("w"), (percent * d + 100 * e).alias("v"), "x")
        found = links if found is None else found.union(links)
        found = written(found, tries)
    return found


def home_pairs(postings: DataFrame, n_postings: int, members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, room) of homes whose members' prefixes share enough tokens that some of them may be similar.

    A token has one posting for each home, with bounds over its members there: their sizes, matches, tokens from this one
    on, and v. Of the tokens that two similar sets share, in order, the kth leaves at least need - k + 1 from it on in
    both; so of the first `matches` ones each leaves need - matches + 1, and only these are met within the join, however
    many share a token. For homes of one member, shared prefix tokens and the larger rest then bound the overlap.
    """
    at = postings.join(members.select("cid", "home", "v"), "cid")
    at = at.groupBy("token", "home").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.min("matches").alias("m"), F.max("matches").alias("ms"), F.max(F.col("n") - F.col("place")).alias("after"), F.max("v").alias("v"))
    met = at.groupBy("token").agg(F.count(F.lit(1)).alias("homes")).filter("homes > 1").select("token")
    at = written(at.join(met, "token"), n_postings, 8 * EACH)
    one, two = (at.select("token", *[F.col(c).alias(f"{c}_{s}") for c in at.columns if c != "token"]) for s in "ab")
    both = lambda f, c: f(f"{c}_a", f"{c}_b")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    fits = (F.col("home_a") < F.col("home_b")) & (100 * F.col("most_a") >= percent * F.col("n_b")) & (100 * F.col("most_b") >= percent * F.col("n_a")) & (both(F.least, "after") + both(F.least, "ms") > need)
    pairs = one.join(two, "token").filter(fits).groupBy(F.col("home_a").alias("a"), F.col("home_b").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("shared"), F.min(both(F.least, "m")).alias("least"), F.max(F.col("v_a") + F.col("v_b")).alias("room"))
    pairs = pairs.filter("shared >= least").select("a", "b", "room")
    of = lambda s: known.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    return written(pairs.join(of("a"), "a").join(of("b"), "b").filter((F.col("room") > 0) | _enough(percent)).select("a", "b", "room"), n_postings)


def _enough(percent: int) -> Column:
    """Whether two sets (n_a, n_b) may be similar by their prefixes (tokens_a, tokens_b): tokens in order, what they share beyond the prefix that ends first is no more than the rest of that set."""
    rest = F.greatest(F.col("n_a") - F.size("tokens_a"), F.col("n_b") - F.size("tokens_b"))
    return F.size(F.array_intersect("tokens_a", "tokens_b")) + rest >= F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def link(docs: DataFrame, percent: int = 80, every: bool = False) -> DataFrame:
    """Rows of docs (doc_id, text, key): doc_id, key, n_shingles, component_id and digest (of its set). See join().

    With `every`, n_links follows, for which all links are counted, not only those that may join components.
    """
    profiled = profile(docs.select("doc_id", "key", "text"))
    rows = profiled.filter("part is null").select("doc_id", "key", "digest", "n")
    counts = _sums(profiled.filter("part is not null").select("part", "chunk", "counts"))
    known = classes(docs, counts, percent, rows.count())
    n, p = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()

    # Tokens of one class only link nothing.
    postings = known.select("cid", "score", "n", "matches", F.size("tokens").alias("p"), F.posexplode("tokens").alias("place", "token"))
    met = postings.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("token")
    postings = written(postings.join(met, "token"), p, 8 * EACH)
    p = postings.count()
    found = homes(postings, p, docs, known, percent, every)
    alone = known.select("cid")
    if found is not None:
        alone = alone.join(found.select("cid"), "cid", "left_anti")
    alone = alone.select("cid", F.col("cid").alias("home"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("v"))
    members = written(alone if found is None else alone.union(found.select("cid", "home", "w", "v")), n)

    pairs = home_pairs(postings, p, members, known, percent)
    near = verify(pairs, n_pairs, docs, known, percent) if (n_pairs := pairs.count()) else None
    joined = [] if found is None else [found.select(F.col("cid").alias("a"), F.col("home").alias("b"))]
    links = None  # of members of different homes, beside those that the homes' slack makes sure
    if near is not None:
        joined.append(near.filter("slack >= 0").select("a", "b"))
        open_ = near.select("a", "b", "slack")
        if not every and (roots := _roots(joined)) is not None:
            of = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
            open_ = open_.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("not (root_a <=> root_b) or root_a is null")
        open_ = written(open_.withColumn("room", F.greatest(-F.col("slack"), F.lit(0))), n_pairs)
        here = open_.select(F.explode(F.array("a", "b")).alias("home")).distinct()
        sized = members.join(here, "home", "left_semi").join(known.select("cid", "n", "tokens"), "cid").withColumnRenamed("cid", "c")
        of = lambda s: sized.select(F.col("home").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("c", "w", "v", "n", "tokens")])
        unsure = (F.col("w_a") + F.col("w_b") > F.col("slack")) & (F.col("v_a") + F.col("v_b") >= F.col("room")) & (F.col("v_a") + F.col("v_b") > 0) & (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
        unsure = open_.join(of("a"), "a").join(of("b"), "b").filter(unsure & _enough(percent))
        unsure = unsure.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), F.lit(0).cast("long").alias("room"))
        unsure = written(unsure)
        if n_unsure := unsure.count():
            links = verify(unsure, n_unsure, docs, known, percent)
            joined.append(links.select("a", "b"))
    roots = _roots(joined)

    named = _rooted(known.select("cid", "rep", "digest"), roots)
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "root").select("digest", "component_id")
    own = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "digest"]
    if every:
        named = named.join(_near(rows, known, members, found, near, links, percent), "digest")
        # All documents of its own set and of similar ones, but itself.
        rows = rows.withColumn("self", F.col("doc_id").isNotNull().cast("long"))
        own = own.withColumn("n_links", F.lit(0).cast("long"))
        return rows.filter("n > 0").join(named, "digest").select(*columns, (F.col("near") - F.col("self")).alias("n_links")).union(own.select(*columns, "n_links"))
    return rows.filter("n > 0").join(named, "digest").select(*columns).union(own.select(*columns))


def _near(rows: DataFrame, known: DataFrame, members: DataFrame, found: DataFrame | None, near: DataFrame | None, links: DataFrame | None, percent: int) -> DataFrame:
    """(digest, near) of classes: the documents of a class and of all classes that are similar to it.

    Members of homes of slack s are similar if w_a + w_b <= s: counted by sums of documents up to a w, of which a home has
    no more than tokens. What stays unsure within a home is counted by the members' differences from it, what stays
    unsure between homes is in links.
    """
    sizes = rows.filter("n > 0").groupBy("digest").agg(F.count_distinct("doc_id").alias("docs"))
    sizes = written(known.select("cid", "digest", "n").join(sizes, "digest").join(members, "cid"))
    hist = written(sizes.groupBy("home", "w").agg(F.sum("docs").alias("docs")))
    within = sizes.filter("cid = home").select(F.col("home").alias("a"), F.col("home").alias("b"), ((100 - percent) * F.col("n")).alias("slack"))
    to = within
    if near is not None:
        sure = near.filter("slack >= 0").select("a", "b", "slack")
        to = to.union(sure).union(sure.select(F.col("b").alias("a"), F.col("a").alias("b"), "slack"))
    # For each pair of homes: b's documents by w, and a's questions how many of them lie up to slack - w.
    asked = to.join(hist.select(F.col("home").alias("a"), F.col("w").alias("w")), "a").select("a", "b", (F.col("slack") - F.col("w")).alias("at"), F.lit(1).alias("kind"), "w", F.lit(0).cast("long").alias("docs"))
    given = to.join(hist.select(F.col("home").alias("b"), F.col("w").alias("at"), "docs"), "b").select("a", "b", "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("w"), "docs")
    up = Window.partitionBy("a", "b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = asked.union(given).withColumn("near", F.sum("docs").over(up)).filter("kind = 1").groupBy(F.col("a").alias("home"), "w").agg(F.sum("near").alias("near"))
    limits = within.select(F.col("a").alias("home"), "slack")
    counted = sizes.join(limits, "home").join(sums, ["home", "w"])
    # Its own documents count for each class, though its distance from its home may say less.
    out = counted.select("cid", (F.col("near") + F.when(2 * F.col("w") > F.col("slack"), F.col("docs")).otherwise(0)).alias("near"))
    if found is not None:
        out = out.union(_by_differences(sizes.join(found.select("cid", "x"), "cid").join(limits, "home"), percent))
    if links is not None:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        out = out.union(both.join(sizes.select(F.col("cid").alias("b"), "docs"), "b").select(F.col("a").alias("cid"), F.col("docs").alias("near")))
    return out.groupBy("cid").agg(F.sum("near").alias("near")).join(sizes.select("cid", "digest"), "cid").select("digest", "near")


def _by_differences(members: DataFrame, percent: int) -> DataFrame:
    """(cid, near): the documents of members (cid, home, w, x, docs, slack) of the same home that are similar though w doesn't tell.

    The slack of two members is that of the home - w_a - w_b + (100 + percent) * the tokens that their differences share.
    Blocks of about BLOCK members meet each other, each pair of blocks in a task of its own, and send sums, not pairs.
    """
    most = members.groupBy("home").agg(F.max("w").alias("most"))
    open_ = members.join(most, "home").filter(F.col("w") + F.col("most") > F.col("slack"))
    blocks = open_.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).select("home", "blocks")
    dealt = open_.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("home", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "w", "x", "docs", "slack")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        w, docs, block = (pdf[c].to_numpy(np.int64) for c in ("w", "docs", "block"))
        sets = [np.asarray(x, dtype=np.int64) for x in pdf["x"]]
        owner, token = np.repeat(np.arange(n), [*map(len, sets)]), np.concatenate(sets)
        _, token = np.unique(token, return_inverse=True)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        shared, starts = np.zeros((n, n), dtype=np.float32), np.searchsorted(token, np.arange(0, token[-1] + 1 + COLUMNS, COLUMNS))
        for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            held = np.zeros((n, COLUMNS), dtype=np.float32)
            held[owner[a:b], token[a:b] - k * COLUMNS] = 1
            shared += held @ held.T
        base = int(pdf["slack"].iloc[0]) - w[:, None] - w[None, :]
        fits = (base < 0) & (base + (100 + percent) * shared.astype(np.int64) >= 0)
        fits &= (block[:, None] != block[None, :]) | (key[1] == key[2])
        np.fill_diagonal(fits, False)
        return pd.DataFrame({"cid": pdf["cid"], "near": fits @ docs})

    return dealt.groupBy("home", "i", "j").applyInPandas(count, "cid long, near long")


def _roots(links: list[DataFrame]) -> DataFrame | None:
    """(node, root) of all nodes of the tables (a, b) of links; None if there are none."""
    if not links:
        return None
    n = sum(x.count() for x in links)
    return written(components(reduce(DataFrame.union, links), n), 2 * n) if n else None


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of their cid: itself if it is in no link."""
    if roots is None:
        return rows.withColumn("root", F.col("cid"))
    return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach), n_links (other documents that it links with).

    A document's set has its distinct word 5-grams, A-Z lower-cased; with fewer words, all of them as one. Two documents
    link when 100 * intersection >= percent * union. Null texts and those without words have empty sets and link with
    nothing, each its own component; equal sets are one class, of which the smallest doc_id stands for all; null ids are
    passed over where there is another; repeated rows are of the same component; an empty table gives no rows. Other
    columns of docs are not read. N-grams are told apart by 64-bit hashes and sets by 128-bit ones.
    """
    out = link(docs.select("doc_id", "text", F.lit(None).cast("binary").alias("key")), percent, every=True)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs, of each component the row of the smallest doc_id (of several, one text's); rows without words all stay. Columns are unchanged.

    A null doc_id goes last; of rows that repeat doc_id and text one stays; an empty table gives no rows.
    """
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    linked = link(docs.select("doc_id", "text", key.alias("key")), percent)
    first = Window.partitionBy("component_id").orderBy(F.col("doc_id").isNull(), "doc_id", "digest")
    kept = linked.filter("n_shingles > 0 and (doc_id = component_id or component_id is null)").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    mine, its_key, its_id = (fresh(name, docs.columns) for name in ("key", "kept_key", "kept_id"))
    kept = kept.select(F.col("doc_id").alias(its_id), F.col("key").alias(its_key))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    with_words = docs.filter(~wordless).withColumn(mine, key)
    joined = with_words.join(kept, F.col(mine).eqNullSafe(F.col(its_key)) & F.col("doc_id").eqNullSafe(F.col(its_id)), "left_semi")
    # Rows that repeat doc_id and text leave one.
    return joined.dropDuplicates(["doc_id", mine]).select(*docs.columns).union(docs.filter(wordless))
