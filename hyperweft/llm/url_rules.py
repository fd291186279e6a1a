"""Operator 8: URL filters by fixed host rules and mined association rules. Built-in functions and Spark's FP-growth only."""

from __future__ import annotations

from math import ceil, log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path); a rule fits its host and all subdomains if the URL's path starts with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK = "=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? or #. Null, or without ://: both empty."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def fixed_rule(rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest fixed rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """The tokens of a URL: its host, its domain and every label before it, every path segment, every query key and pair.

    What holds digits is a token as it is and one with 0 for each number. The miner's least support bounds the combinations.
    """
    host, path = F.col("host"), F.col("path")
    zeros = lambda x: F.regexp_replace(x, r"\d+", "0")
    pick = lambda kind, value: F.when(value != "", F.concat(F.lit(kind + ":"), value))
    all_of = lambda kind, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    both = lambda kind, values: F.concat(all_of(kind, values), all_of(kind, F.transform(values, zeros)))
    labels = F.split(host, r"\.")
    first = F.regexp_extract(path, r"^/([^/]+)", 1)
    pairs = F.split(F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit("")), "[&;]")
    keys = F.transform(pairs, lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    made = [
        pick("top", F.regexp_extract(host, r"([^.]+)$", 1)),
        pick("domain", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
        pick("host", host),
        pick("first", first),
        pick("first", zeros(first)),
        pick("ending", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        pick("depth", F.least(F.size(F.split(path, "/")), F.lit(9)).cast("string")),
    ]
    # The labels before the domain; "any" is a segment wherever it is.
    many = F.concat(both("name", F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))), both("any", F.split(path, "/")), all_of("key", keys), both("pair", F.filter(pairs, lambda x: x.contains("="))))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*made)), many)))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.95, noise: float = 0.01) -> DataFrame:
    """Rules (tokens, confidence, support) from labelled (tokens, verdict): token combinations that come with 'block'.

    All labelled URLs are mined. Pruned are rules below the least support or confidence, those that chance may have made,
    and those of which a part is a rule that is at least as confident; all others stay. Chance: were labels dealt without
    regard to URLs, blocks among the n URLs of a rule would be as frequent as among all; a share as high as the rule's
    then has a probability of at most exp(-n KL(confidence, share of all)), by Chernoff's bound, and that must not
    exceed `noise` over the number of combinations counted (Bonferroni). Three facts spare the miner combinations that
    would be pruned: a token too rare among blocked URLs is in no rule; one that is on blocked URLs only is a rule, and no
    wider one stays; and of tokens that are on the same URLs no rule needs two, so one is mined for all and the rules are
    multiplied out.
    """
    urls = written(labelled.select(F.monotonically_increasing_id().alias("id"), "tokens", (F.col("verdict") == "block").alias("bad")))
    n, bad = urls.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(1, ceil(min_support * n - 1e-9))
    each = urls.select("id", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    # Two 64-bit sums of hashes tell whether tokens are on the same URLs.
    where = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("all"), F.count_if("bad").alias("n_bad"), *where).filter(F.col("all") >= least)
    alike = written(seen.groupBy("all", "n_bad", "x1", "x2").agg(F.min("token").alias("token"), F.collect_list("token").alias("members")))
    counted = alike.count()
    share = lambda k: F.round(F.col(k) / n, 9).alias("support")
    pure = alike.filter((F.col("all") == F.col("n_bad")) & (F.col("n_bad") >= least)).select(F.explode("members").alias("token"), F.lit(1.0).alias("confidence"), share("n_bad"))
    pure = pure.select(F.array("token").alias("tokens"), "confidence", "support")
    mixed = written(alike.filter((F.col("all") > F.col("n_bad")) & (F.col("n_bad") >= least)).select("token", "members"))
    items = each.join(mixed.select("token"), "token").groupBy("id").agg(F.collect_list("token").alias("items"))
    items = urls.join(items, "id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(written(items))
    counted += model.freqItemsets.filter((F.size("items") > 1) & ~F.array_contains("items", BLOCK)).count()
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    rules, pure = (written(x.filter(_surprising(n, bad, noise / max(1, counted)))) for x in (rules, pure))
    # A narrower rule is looked up by its first token, which the wider one has too.
    wider = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.get("tokens", F.lit(0)).alias("token"))
    fits = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))
    extra = rules.withColumn("token", F.explode("tokens")).join(wider, "token").filter(fits).select("tokens").distinct()
    rules = rules.join(extra, "tokens", "left_anti")
    # Each token stands for all that are on the same URLs: a rule for every choice of one of each.
    rules = rules.withColumn("token", F.explode("tokens")).join(mixed, "token").groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("members"))
    choices = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda a, m: F.flatten(F.transform(a, lambda x: F.transform(m, lambda t: F.concat(x, F.array(t))))))
    rules = rules.select(F.explode(choices).alias("tokens"), "confidence", "support")
    return written(pure.union(rules.select(F.array_sort("tokens").alias("tokens"), "confidence", "support")))


def _surprising(n: int, bad: int, level: float) -> Column:
    """Whether a rule (confidence, support) would by chance, with `bad` blocks among n URLs, have a probability of `level` at most."""
    usual = bad / n if n else 0.0
    if not 0 < usual < 1:
        return F.lit(False)
    c = F.col("confidence")
    divergence = c * F.log(c / usual) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - usual))).otherwise(0.0)
    return (c > usual) & (F.col("support") * n / c * divergence >= -log(level))


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Of rows (id, tokens) those that a rule fits: id, best (the most confident one). Rules lie in an inverted index by their rarest token.

    Rules are as many as the labels bear out, so the index is broadcast only where its size says so. Rows meet again by their own id.
    """
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    named = rules.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    rarest = named.groupBy("tokens", "confidence", "support").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = written(rarest.withColumnRenamed("tokens", "needs"))
    hits = rows.withColumn("token", F.explode("tokens")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    return hits.groupBy("id").agg(F.max(F.struct("confidence", "support", "needs")).alias("best"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, **options) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule (a fixed rule like 'net/', or null), verdict, mined (the mined rule's tokens, or null).

    labels (page_id, bad) says of some pages whether they are bad, 0 or 1; a page that is labelled more than once is bad if
    any label says so, null labels say nothing. Association rules mined from all labelled URLs block pages that no fixed
    rule decides; those that none fits are allowed. A null url, or one without ://, has empty host and path, and no fixed
    rule; a null page_id has no label; repeated rows are judged alike; an empty table, or one without labels, gives no rows
    or no mined rules. Other columns of pages are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fixed", fixed_rule(rules))
    rows = written(rows.withColumns({"tokens": url_tokens(F.col("url")), "id": F.monotonically_increasing_id()}).drop("url"))
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad")).filter("bad is not null")
    labelled = rows.select("page_id", "tokens").join(known, "page_id").select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict"))
    out = ["page_id", "host", "path", F.col("fixed.rule").alias("rule")]
    plain = rows.select(*out, F.coalesce("fixed.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    if labelled.filter("verdict = 'block'").isEmpty():
        return plain
    mined = mine(labelled, **options)
    if mined.isEmpty():
        return plain
    best = match(rows.filter("fixed is null").select("id", "tokens"), mined)
    judged = rows.join(best.withColumn("blocked", F.lit(True)), "id", "left")
    verdict = F.coalesce("fixed.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), F.array_join("best.needs", " ").alias("mined"))
