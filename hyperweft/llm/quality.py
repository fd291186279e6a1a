"""Operator 3: quality rules whose cutoffs are risk-controlled on labelled holdouts. Built-in functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, shielded, written

#: A window of a repeat, in words.
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims")
#: Scores in thousandths, each high in bad documents, by name.
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words", "capitals", "exclaims")
#: Quantiles of the tuning half's good documents that are tried as cutoffs, in the order in which they are tested.
QUANTILES = (1.0, 0.999, 0.998, 0.995, 0.99, 0.98, 0.95)


def repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more, the first included.

    Windows are told apart by a 64-bit hash. Sorted with their places, equal ones are neighbours; each repeated window
    then adds the words up to the next one, WINDOW at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def places(s: Column) -> Column:
        same = lambda e, x: F.coalesce(e["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda e, j: same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1)))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(F.sort_array(F.transform(let(s, places), lambda e: e["i"])), covered)

    found = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0)).cast("long")


def counts(text: Column) -> Column:
    """Struct of COUNTS of a text (null: 0); words and lines are split once."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.char_length(F.translate(text, chars, ""))

    def of(words: Column, lines: Column) -> Column:
        each = {
            "n_words": F.size(words),
            "word_chars": without(" \t\n\x0b\f\r"),
            "n_symbols": F.char_length(text) - without("#*$%&|<>"),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_capitals": F.char_length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_exclaims": F.char_length(text) - without("!"),
        }
        return F.struct(*[each[k].cast("long").alias(k) for k in COUNTS])

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def features(docs: DataFrame) -> DataFrame:
    """docs (text and others) with COUNTS instead of text."""
    return docs.withColumn("_counts", counts(F.col("text"))).drop("text").select("*", "_counts.*").drop("_counts")


def base_failed(c=F.col) -> Column:
    """c gives a count by its name: a column's, or a struct's field."""
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def scores(c=F.col) -> Column:
    """One array of the RULES' scores, from the counts."""
    per = lambda a, b: F.floor(1000 * c(a) / F.greatest(c(b), F.lit(1)))
    mean = per("word_chars", "n_words")
    return F.array(per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), mean, -mean, per("n_capitals", "word_chars"), per("n_exclaims", "n_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), exactly summed; each step keeps the sum relative to its last term."""
    first = F.struct((n * F.lit(_ln(1 - p))).cast("double").alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        ratio = (n - j + 1) / j * (p / (1 - p))
        return F.struct((a["t"] + F.ln(ratio)).alias("t"), (a["s"] / ratio + 1).alias("s"))

    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(js, first, step, lambda a: a["t"] + F.ln(a["s"]))


def _ln(x: float) -> float:
    return log(x)


def stratum(lang: Column) -> Column:
    """A stratum's key: the language's, or that of null."""
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit("n"))


def fit(counted: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, seed: int = 11) -> DataFrame:
    """Cutoffs (stratum, cutoffs) of the languages that have some: an array by RULES, null where a rule takes no part.

    A document with any score above its stratum's cutoff is rejected. With probability 1 - delta, over all strata at once,
    no stratum's rules together reject more than a share alpha of its good documents (labels.quality = 1). Candidates, a
    vector of cutoffs per quantile, come from one half of the stratum's labelled documents: each rule's quantile of the
    good ones' scores, for rules that there reject more bad documents than ten times the good ones. The other half tests
    each vector as a whole by the exact binomial bound (Clopper-Pearson) on its rejected good documents. Multiple testing:
    a stratum's vectors are tested in a fixed sequence, from the largest quantile on, and none after one that fails, so
    that all have the stratum's whole level; that is delta divided by the number of strata (Bonferroni) whose halves are
    large enough to pass at that level at all, which sizes alone decide. Of the vectors that pass, the one that rejects
    most in the tuning half, by the same count, is taken. Strata that are too small have no cutoffs: nothing is promised
    for them that isn't kept. A null language is a stratum as any other.
    All labels are used; repeated labels of a doc_id count once, as the lowest, and null ones not at all.
    """
    n_docs = counted.count()
    quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = counted.filter(~base_failed()).select("doc_id", stratum(F.col("lang")).alias("stratum"), scores().alias("scores")).join(quality, "doc_id")
    known = written(known.select("stratum", "scores", (F.col("good") == 1).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0).alias("tune")), n_docs)
    # How many strata can pass among themselves: the more there are, the more good documents each test needs.
    tests = known.filter("good and not tune").groupBy("stratum").agg(F.count(F.lit(1)).alias("tests"))
    able = tests.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("tests"), "stratum"))).filter(F.col("tests") * _ln(1 - alpha) <= F.log(delta / F.col("nth")))
    strata = able.agg(F.max("nth")).first()[0]
    # Counts by score bound what follows: the scores are whole thousandths.
    by_rule = known.filter("tune").select("stratum", "good", F.posexplode("scores").alias("rule", "score"))
    hist = by_rule.groupBy("stratum", "rule", "score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    up = Window.partitionBy("stratum", "rule").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum", "rule")
    c = hist.withColumns({f"{x}_kept": F.sum(x).over(up) for x in ("good", "bad")} | {f"{x}_all": F.sum(x).over(whole) for x in ("good", "bad")})
    # A quantile's cutoff is the first score that keeps as many of the good ones.
    c = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(len(QUANTILES) - 1)))).withColumn("least", F.ceil(F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("q") + 1) * F.col("good_all")))
    c = c.filter((F.col("good_all") > 0) & (F.col("good_kept") >= F.col("least"))).groupBy("stratum", "q", "rule")
    c = c.agg(F.min_by(F.struct("score", (F.col("bad_all") - F.col("bad_kept") - 10 * (F.col("good_all") - F.col("good_kept"))).alias("gain")), "score").alias("c")).filter("c.gain > 0")
    vectors = c.groupBy("stratum", "q").agg(F.map_from_entries(F.collect_list(F.struct("rule", "c.score"))).alias("by_rule"))
    vectors = vectors.select("stratum", F.struct("q", F.array(*[F.element_at("by_rule", F.lit(i)) for i in range(len(RULES))]).alias("cutoffs")).alias("v"))
    vectors = written(vectors.groupBy("stratum").agg(F.sort_array(F.collect_list("v")).alias("vectors")), n_docs)
    judged = known.join(vectors, "stratum").select("stratum", "good", "tune", F.explode("vectors").alias("v"), "scores")
    judged = judged.withColumn("hit", rejects(F.col("scores"), F.col("v.cutoffs")))
    judged = judged.groupBy("stratum", "v").agg(F.count_if(F.expr("good and not tune")).alias("n"), F.count_if(F.expr("hit and good and not tune")).alias("k"), F.count_if(F.expr("hit and tune and not good")).alias("bad"), F.count_if(F.expr("hit and tune and good")).alias("good"))
    n, k = F.col("n"), F.col("k")
    passed = F.when(k < n * alpha, log_binomial_cdf(k, n, alpha) <= _ln(delta / max(1, strata or 0))).otherwise(False)
    in_order = Window.partitionBy("stratum").orderBy("v.q").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("passed", F.min(passed).over(in_order)).filter("passed")
    return written(judged.groupBy("stratum").agg(F.max_by("v.cutoffs", F.struct(F.col("bad") - 10 * F.col("good"), -F.col("v.q"))).alias("cutoffs")), n_docs)


def rejects(found: Column, cutoffs: Column) -> Column:
    """Whether any of the scores found is above its cutoff."""
    return F.exists(F.zip_with(found, cutoffs, lambda x, c: F.coalesce(x > c, F.lit(False))), lambda x: x)


def _judged(counted: DataFrame, labels: DataFrame, options: dict) -> DataFrame:
    """counted (doc_id, lang, COUNTS and others) with base_failed and kept."""
    cutoffs = fit(counted, labels.select("doc_id", "quality"), **options)
    # A row for each language that has cutoffs: broadcast if its size says so, skewed languages are split if not.
    out = counted.withColumn("stratum", stratum(F.col("lang"))).join(cutoffs, "stratum", "left")
    rejected = F.coalesce(rejects(scores(), F.col("cutoffs")), F.lit(False))
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected})


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, COUNTS, base_failed, kept.

    Null texts count as empty ones and fail the base rules, null languages are a stratum of their own, repeated rows are
    judged alike, empty tables of documents or labels give no rows or no cutoffs. Other columns of docs are not read.
    """
    counted = written(features(docs.select("doc_id", "text", "lang")))
    return _judged(counted, labels, options).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that quality_rules() keeps, all their columns unchanged, whatever their names. Texts are written with their counts, so that they are counted once."""
    rows, columns = shielded(docs)
    of = lambda c: rows[docs.columns.index(c)]
    counted = written(rows.withColumns({"doc_id": of("doc_id"), "lang": of("lang"), "counts": counts(of("text"))}).select("*", "counts.*").drop("counts"))
    return _judged(counted, labels, options).filter("kept").select(*columns)
