"""Operator 7: secret scans by fixed patterns and a randomness test battery. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shielded, written

#: Kinds in the order of ties, with pattern, the group whose length counts, and that length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 1, 16),
    "hex": (r"[0-9a-f]{32,}", 1, 32),  # runs are maximal, so this finds those of [0-9a-f]+ that are long enough
}
RANDOM = "random"
#: What is tested for randomness: runs of these characters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings, the narrowest first: pattern, the alphabet in four classes, from those that ordinary tokens use most to
#: those that they use least, and the share of each class in ordinary tokens (words, names, numbers).
ENCODINGS = {
    "digits": (r"^[0-9]+$", ("01", "23", "456", "789"), (0.35, 0.22, 0.25, 0.18)),
    "hex": (r"^[0-9a-f]+$", ("01234", "56789", "ace", "bdf"), (0.62, 0.25, 0.09, 0.04)),
    "HEX": (r"^[0-9A-F]+$", ("01234", "56789", "ACE", "BDF"), (0.62, 0.25, 0.09, 0.04)),
    "lower": (r"^[a-z]+$", ("etaoins", "rhldcum", "fpgwyb", "vkxjqz"), (0.6, 0.28, 0.09, 0.03)),
    "upper": (r"^[A-Z]+$", ("ETAOINS", "RHLDCUM", "FPGWYB", "VKXJQZ"), (0.6, 0.28, 0.09, 0.03)),
    "base32": (r"^[A-Z2-7]+$", ("ETAOINSR", "HLDCUMFP", "GWYBVKXJ", "QZ234567"), (0.63, 0.25, 0.08, 0.04)),
    "lower36": (r"^[a-z0-9]+$", ("etaoinsrh", "ldcumfpgw", "ybvkxjqz0", "123456789"), (0.62, 0.22, 0.06, 0.1)),
    "letters": (r"^[A-Za-z]+$", ("etaoinsrhldcu", "mfpgwybvkxjqz", "ETAOINSRHLDCU", "MFPGWYBVKXJQZ"), (0.72, 0.14, 0.11, 0.03)),
    "base64": (r"^[A-Za-z0-9+/_-]+$", ("etaoinsrhldcu", "mfpgwybvkxjqz", "ETAOINSRHLDCUMFPGWYBVKXJQZ", "0123456789+/_-"), (0.6, 0.17, 0.1, 0.13)),
}
#: Lower ends of the length classes within which discoveries are controlled.
LENGTHS = (20, 24, 32, 40, 48, 64, 128)
#: Share of uniformly random tokens that the battery may turn away.
TURNED_AWAY = 0.001
#: A noncharacter that marks matches. No pattern matches it; where a text has it, the replacement character stands in.
MARK, STAND_IN = "￿", "�"
#: Pieces of a text whose lengths are summed one by one; blocks of them are summed first.
PIECES = 64


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, piece), in code points, of the pattern's matches: marked, split at the marks, lengths summed, by blocks and then within them."""
    marked = F.regexp_replace(F.translate(text, MARK, STAND_IN), F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + F.char_length(p))

    def of(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
        return let(F.aggregate(blocks, first, step)["starts"], lambda starts: F.flatten(F.transform(blocks, lambda b, k: within(b, F.get(starts, k)))))

    def within(block: Column, start: Column) -> Column:
        # The pieces at odd places are the matches: what lies between two, if only the empty text, is at even ones.
        hits = F.transform(F.sequence(F.lit(1), F.size(block) - 1, F.lit(2)), lambda i: F.struct((start + total(F.slice(block, F.lit(1), i))).alias("start"), F.get(block, i).alias("piece")))
        hits = F.when(F.size(block) > 1, hits).otherwise(F.array().cast("array<struct<start:int,piece:string>>"))
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.char_length(h["piece"])).alias("end"), h["piece"].alias("piece")))

    blocks = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(PIECES)), lambda i: F.slice(p, i, F.lit(PIECES)))
    found = let(let(F.split(marked, MARK, -1), blocks), of)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(F.array().cast("array<struct<start:int,end:int,piece:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, place in KINDS, end, kind) of the fixed patterns, sorted."""

    def of(place: int, kind: str, pattern: str, group: int, least: int) -> Column:
        long_enough = lambda m: F.char_length(F.regexp_extract(m["piece"], f"({pattern})", group)) >= least
        span = lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(F.filter(matches(text, pattern), long_enough), span)

    each = [of(i, kind, *rule) for i, (kind, rule) in enumerate(KINDS.items())]
    return F.sort_array(F.concat(*each))


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) for z of 0 or more, to 1e-7, by the polynomial of Abramowitz and Stegun, 26.2.17 (fixed values)."""
    t = 1 / (1 + 0.2316419 * z)
    weights = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = reduce(lambda rest, w: t * (w + rest), reversed(weights), F.lit(0.0))
    return F.exp(-z * z / 2) / sqrt(2 * pi) * poly


def battery(token: Column, classes: Column, sizes: Column) -> Column:
    """Struct of p-values of three tests of a token against uniformly random symbols: chi, runs, serial; and counts by class.

    chi: chi-squared of the counts of the alphabet's four classes (three degrees of freedom), upper tail. runs: runs in
    the first and in the last two classes (Wald and Wolfowitz), given the counts, two-sided with continuity correction;
    0 if all are on one side. serial: lag-1 correlation of the symbols' places in the alphabet, two-sided; 0 if all are
    the same. classes and sizes: the alphabet's classes as one array of strings, and their sizes.
    """
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e)

    def tests(x: Column) -> Column:
        n = F.size(x).cast("double")
        end = lambda k: total(F.transform(F.slice(sizes, 1, k), lambda s: s.cast("double")))
        counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.size(F.filter(x, lambda e: (e > end(k)) & (e <= end(k + 1)))).cast("double"))
        return let(counts, lambda c: of(x, n, c, end(F.lit(2)), end(F.lit(4))))

    def of(x: Column, n: Column, counts: Column, half: Column, size: Column) -> Column:
        expected = F.transform(sizes, lambda s: n * s / size)
        chi2 = total(F.zip_with(counts, expected, lambda c, e: (c - e) * (c - e) / e))
        chi = let(chi2, lambda v: F.least(F.lit(1.0), 2 * upper_tail(F.sqrt(v)) + F.sqrt(2 * v / pi) * F.exp(-v / 2)))
        low = F.get(counts, 0) + F.get(counts, 1)
        runs = F.size(F.filter(x, lambda e, i: (i == 0) | ((e > half) != (F.get(x, i - 1) > half)))).cast("double")
        mean = 1 + 2 * low * (n - low) / n
        spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        by_runs = F.when((low > 0) & (low < n) & (spread > 0), F.least(F.lit(1.0), 2 * upper_tail(F.greatest(F.abs(runs - mean) - 0.5, F.lit(0.0)) / spread))).otherwise(0.0)
        s1, s2 = total(x), total(F.transform(x, lambda e: e * e))
        lag = total(F.transform(x, lambda e, i: F.coalesce(e * F.get(x, i + 1), F.lit(0.0))))
        ends = F.get(x, 0) + F.element_at(x, -1)
        middle = s1 / n
        variance = s2 - s1 * middle
        r = (lag - middle * (2 * s1 - ends) + (n - 1) * middle * middle) / variance
        serial = F.when(variance > 0, 2 * upper_tail(F.abs((r + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        return F.struct(chi.alias("chi"), by_runs.alias("runs"), F.least(F.lit(1.0), serial).alias("serial"), counts.alias("counts"))

    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return let(F.transform(chars, lambda c: F.position(c, F.array_join(classes, "")).cast("double")), tests)


def _encoding(token: Column) -> Column:
    """Struct of the narrowest encoding of a token: name, classes, sizes, weights (log of each class's share at random over that in ordinary tokens)."""

    def one(name: str) -> Column:
        _, classes, usual = ENCODINGS[name]
        sizes = [*map(len, classes)]
        weights = [log(n / sum(sizes) / p) for n, p in zip(sizes, usual, strict=True)]
        return F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, classes)).alias("classes"), F.array(*map(F.lit, sizes)).alias("sizes"), F.array(*map(F.lit, weights)).alias("weights"))

    return reduce(lambda rest, e: F.when(token.rlike(e[1][0]), one(e[0])).otherwise(rest), reversed(ENCODINGS.items()), one("base64"))


def candidates(text: Column) -> Column:
    """Array of (start, end, encoding, length class, random, score) of all tokens long enough to test.

    random: no test of the battery turns the token away (Bonferroni over the three, TURNED_AWAY in all). score: the log
    likelihood ratio, in tenths, rounded down, of random symbols over an ordinary token's, by the classes' counts; by
    Markov's inequality no more than exp(-score) of ordinary tokens have that much, whatever their length.
    """

    def tested(m: Column) -> Column:
        token = m["piece"]
        length = reduce(lambda rest, n: F.when(F.char_length(token) >= n, F.lit(n)).otherwise(rest), LENGTHS, F.lit(LENGTHS[0]))

        def of(e: Column, b: Column) -> Column:
            ratio = F.aggregate(F.zip_with(b["counts"], e["weights"], lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x)
            random = 3 * F.least(b["chi"], b["runs"], b["serial"]) >= TURNED_AWAY
            score = F.greatest(F.lit(0), F.least(F.floor(10 * ratio), F.lit(7000))).cast("int")
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), e["name"].alias("encoding"), length.alias("length"), random.alias("random"), score.alias("score"))

        return let(_encoding(token), lambda e: let(battery(token, e["classes"], e["sizes"]), lambda b: of(e, b)))

    return F.transform(matches(text, TOKEN), tested)


def limits(found: DataFrame, level: float) -> dict[int, int]:
    """The least score, by length class, of what is reported: Benjamini and Hochberg's step on exp(-score), so that ordinary tokens are expected to be no more than `level` of it.

    All tokens of a class count, those that the battery turns away with the p-value 1. Classes without a discovery have no
    limit. What is collected is one row per class.
    """
    c = found.select(F.explode("candidates").alias("c")).select("c.length", F.when(F.col("c.random"), F.col("c.score")).otherwise(0).alias("score"))
    hist = c.groupBy("length", "score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("length").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("length")
    hist = hist.withColumns({"up_to": F.sum("n").over(down), "all": F.sum("n").over(every)})
    best = hist.filter((F.col("score") > 0) & (F.exp(-F.col("score") / 10) * F.col("all") <= level * F.col("up_to"))).groupBy("length").agg(F.min("score").alias("score"))
    return {x["length"]: x["score"] for x in best.collect()}


def all_spans(held: dict[int, int], base: Column, found: Column) -> Column:
    """base and, of the candidates found that touch none of it, those that pass; sorted."""
    limit = reduce(lambda rest, x: lambda c: F.when(c["length"] == x[0], F.lit(x[1])).otherwise(rest(c)), sorted(held.items()), lambda c: F.lit(None).cast("int"))
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter(found, lambda c: c["random"] & F.coalesce(c["score"] >= limit(c), F.lit(False)) & apart(c))
    span = lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("place"), c["end"].alias("end"), F.lit(RANDOM).alias("kind"))
    return F.sort_array(F.concat(base, F.transform(more, span)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, base (array of spans of the fixed patterns), spans (with those that look random).

    A span is (start, place, end, kind), code points, end exclusive. Null texts count as empty ones and have no spans;
    texts of any length are scanned whole; repeated rows are scanned alike; an empty table gives no rows. Other columns
    of docs are not read.
    """
    text = F.coalesce("text", F.lit(""))
    found = written(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("candidates")))
    return found.select("doc_id", "base", all_spans(limits(found, level), F.col("base"), F.col("candidates")).alias("spans"))


def redact(docs: DataFrame, level: float = 0.01, put: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of spans in text replaced by `put`, and n_chars, if there is one, counted anew.

    Texts without spans, null ones among them, stay as they are, as do all other columns, whatever their names; repeated
    rows are treated alike; an empty table gives no rows.
    """
    rows, columns = shielded(docs)
    whole = rows[docs.columns.index("text")]
    text = F.coalesce(whole, F.lit(""))
    found = written(rows.withColumns({"base": base_spans(text), "candidates": candidates(text)}))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        before = F.when(s["start"] >= a["at"], F.array(F.substr(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(put))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], before).alias("parts"))

    whole = F.col(f"c{docs.columns.index('text')}")
    out = found.withColumn("spans", all_spans(limits(found, level), F.col("base"), F.col("candidates")))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(whole, a["at"] + 1, F.char_length(whole))))
    out = out.withColumns({"hit": F.size("spans") > 0, "clean": F.when(F.size("spans") > 0, clean)})
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return out.select(*[F.when(F.col("hit"), new[c]).otherwise(F.col(f"c{i}")).alias(c) if c in new else x for i, (c, x) in enumerate(zip(docs.columns, columns, strict=True))])
