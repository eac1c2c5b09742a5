"""URL filter by a character language-model ratio, in DataFrame operations only.

Rules label the URLs they fit. From the accepted and the rejected ones two variable-order Markov models of characters are counted
over all pages, each smoothed after Witten and Bell: a context of two characters is trusted as far as it was seen, the rest of the
probability comes from one character, none, and the uniform distribution. The alphabet is folded to 32 symbols, so a model
has 32**3 numbers whatever the corpus, and scoring a URL looks them up inside the task that reads it, without a shuffle.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, Stash, ascii_lower, fold_of, read

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Folded alphabet: letters, a digit, three marks of structure, any other character, and the edge of a URL.
SYMBOLS = LOWER + "0/.-*^"
FOLDS, BINS, SPREAD = 5, 2000, 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring_index(url, "://", 1))
    after = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    host = F.coalesce(F.regexp_extract(after, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The URL over SYMBOLS, two edges before it and one behind."""
    kept = ascii_lower(F.coalesce(url, F.lit("")))
    kept = F.regexp_replace(F.regexp_replace(kept, "[0-9]+", "0"), r"[^a-z0/.\-]", "*")
    return F.concat(F.lit("^^"), kept, F.lit("^"))


def codes(text: Column) -> Column:
    """The trigrams of folded text as numbers below 32**3."""
    one = lambda i: F.instr(F.lit(SYMBOLS), F.substr(text, i, F.lit(1))) - 1
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: one(i) * 1024 + one(i + 1) * 32 + one(i + 2))


def log_ratios(counts: DataFrame) -> list[float]:
    """log P(c | ab; accepted) - log P(c | ab; rejected) for all trigrams abc, from (accepted, code, n): 2 * 32**3 rows at most."""
    tables = []
    rows = counts.collect()
    for side in (True, False):
        n3, n2, n1 = [0] * 32768, [0] * 1024, [0] * 32
        for r in rows:
            if r.accepted == side:
                n3[r.code] += r.n
                n2[r.code % 1024] += r.n
                n1[r.code % 32] += r.n
        p1 = smooth(n1, [1 / 32] * 32)
        p2 = smooth(n2, p1)
        tables.append(smooth(n3, p2))
    return [math.log(a) - math.log(b) for a, b in zip(*tables, strict=True)]


def smooth(counts: list[int], lower: list[float]) -> list[float]:
    """Witten-Bell: in each context, as many counts as it has distinct successors go to the lower order."""
    out = []
    for at in range(0, len(counts), 32):
        own = counts[at : at + 32]
        total, kinds = sum(own), max(1, sum(map(bool, own)))
        back = lower[at % len(lower) : at % len(lower) + 32]
        out += [(n + kinds * p) / (total + kinds) for n, p in zip(own, back, strict=True)]
    return out


def looked_up(text: Column, table: list[float]) -> Column:
    """The mean of the table's numbers over the trigrams of folded text."""
    numbers = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    total = F.aggregate(codes(text), F.lit(0.0), lambda acc, c: acc + F.element_at(numbers, c + 1))
    return total / (F.length(text) - 2)


def url_filter(pages: DataFrame, rules=RULES, stash: Stash | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (the length-normalised log-likelihood ratio).

    The rule's verdict holds where a rule fits; other URLs are allowed if their score reaches the threshold that best separates
    held-out rule-labelled URLs (a fifth of them, by page_id). A null or malformed URL has empty host and path and is scored
    like any other text. Without both labels the models are equal or one-sided and the threshold is 0. Empty tables give empty
    results; repeated rows are judged alike; other columns are ignored."""
    stash = stash or Stash(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = stash.keep(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), folded(F.col("url")).alias("folded"), (F.coalesce(fold_of(F.col("page_id"), FOLDS), F.lit(0)) == 1).alias("held")), "judged")
    labelled = judged.where("rule is not null").withColumn("accepted", F.col("by_rule") == "allow")
    grams = labelled.where("not held").select("accepted", F.explode(codes(F.col("folded"))).alias("code"))
    table = log_ratios(grams.groupBy("accepted", "code").agg(F.count("*").alias("n")))
    scored = judged.withColumn("score", looked_up(F.col("folded"), table))
    bin_ = F.floor((F.greatest(F.least("score", F.lit(SPREAD)), F.lit(-SPREAD)) + SPREAD) / (2 * SPREAD) * BINS).cast("int")
    rows = scored.where("held and rule is not null").groupBy(bin_.alias("bin"), (F.col("by_rule") == "allow").alias("accepted")).agg(F.count("*").alias("n")).collect()
    limit = threshold(rows)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score")


def threshold(rows: list) -> float:
    """The middle of the best cuts by balanced accuracy over a histogram of BINS bins; 0 unless both labels occur."""
    good, bad = [0] * (BINS + 1), [0] * (BINS + 1)
    for r in rows:
        (good if r.accepted else bad)[r.bin] += r.n
    if not sum(good) or not sum(bad):
        return 0.0
    best, at, passed, stopped = -1.0, [], sum(good), 0
    for cut in range(BINS + 1):
        rate = passed / sum(good) + stopped / sum(bad)
        if rate > best + 1e-12:
            best, at = rate, [cut]
        elif rate > best - 1e-12:
            at.append(cut)
        passed -= good[cut]
        stopped += bad[cut]
    return at[len(at) // 2] / BINS * 2 * SPREAD - SPREAD


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))
