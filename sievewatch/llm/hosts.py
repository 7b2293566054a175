"""Verdicts on urls: fixed rules first, else empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

#: Bad rate that the lower posterior bound must exceed, and the bound's distance in standard deviations.
BAD_RATE, DEVIATIONS = 0.3, 1.645
#: Limits of a prior's weight in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _levels(host: Column) -> dict[str, Column]:
    """Registered domain (last two labels) and suffix (last label) of a host."""
    return {
        "domain": F.when(host.contains("."), F.regexp_extract(host, "([^.]*[.][^.]*)$", 1)).otherwise(host),
        "suffix": F.regexp_extract(host, "([^.]*)$", 1),
    }


def _weight(level: DataFrame) -> DataFrame:
    """One row: the weight of the level's prior, by the moments of its rates."""
    sums = level.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").cast("double").alias("t"), F.sum("bad").cast("double").alias("y"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("y2"))
    m = F.col("y") / F.col("t")
    spread = F.col("y2") - F.col("t") * m * m - (F.col("k") - 1) * m * (1 - m)
    between = spread / (F.col("t") - F.col("n2") / F.col("t"))
    rho = F.round(between / (m * (1 - m)), 9)
    weight = F.when((F.col("k") > 1) & (m > 0) & (m < 1) & (rho > 0), (1 - rho) / rho).otherwise(MOST_WEIGHT)
    return sums.select(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), weight)).alias("w"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, mean, bound`` for each host of ``outcomes (host, n, bad)``.

    Hosts shrink towards their registered domain, domains towards their suffix, suffixes towards the
    rate of all pages; ``bound`` is the posterior mean less ``DEVIATIONS`` standard deviations.
    Repeated hosts are added up; hosts without labelled pages get the prior alone.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.select("host", "n", "bad", *[c.alias(k) for k, c in _levels(F.col("host")).items()])
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg((F.sum("bad") / F.sum("n")).alias("m")).select(F.coalesce("m", F.lit(0.0)).alias("m"))
    # one row each: weights of the three priors and the overall rate
    (ws, wd, wh), m = [_weight(x).first().w for x in (suffixes, domains, hosts)], total.first().m
    suffixes = suffixes.select("suffix", ((F.col("bad") + ws * m) / (F.col("n") + ws)).alias("ms"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", ((F.col("bad") + wd * F.col("ms")) / (F.col("n") + wd)).alias("md"))
    a = F.col("bad") + wh * F.col("md")
    t = F.col("n") + wh
    mean = a / t
    return hosts.join(domains, "domain").select(
        "host", "n", "bad", mean.alias("mean"), (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (t + 1))).alias("bound"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound``: one row per page.

    ``rules`` are ``(verdict, "host/path")``; a rule fits its host and all subdomains if the url's path
    starts with its path, the longest wins (of equal length the later in the alphabet). Without a rule the
    verdict is ``block`` if the lower posterior bound of the host's bad rate exceeds ``BAD_RATE``, else ``allow``.
    ``labels (id, bad)`` holds outcomes of pages; pages or outcomes that repeat an id count each
    time, null ids and null outcomes not at all. A null url, or one without ``://``, has the empty
    host, which is a host like any other. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    outcome = labels.where("bad is not null").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    seen = rows.join(outcome, F.col("page_id") == F.col("id"), "left").groupBy("host").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    scores = reputation(seen).select(F.col("host").alias("_host"), F.round("bound", 9).alias("bound"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    own = F.when(F.col("bound") > BAD_RATE, "block").otherwise("allow")
    return rows.join(scores, F.col("host") == F.col("_host")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
