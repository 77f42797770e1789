"""URL filtering: stated rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host, summed to registered domains and to suffixes.
Each level has a beta prior whose mean is the posterior mean of the level above and whose strength is fitted
by moments: with n and y the counts of the groups that have labels, the overdispersion of y / n beyond
binomial noise gives rho, and the strength is (1 - rho) / rho, held within 1 and 200. A host with few labels
thus leans on its domain, a domain on its suffix, a suffix on the whole. A host is blocked if the lower
posterior bound of its bad rate (mean - z * deviation of the beta) is over the threshold.

The suffix is the last label, or the last two where the second last is a usual registry label (co, com, net,
org, gov, edu, ac) under a two-letter country; the registered domain has one label more. Ports stay part of
the host, as the contract has it, but are left out of the domain.

Counts are summed per host before anything is joined, and only hosts are joined back.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule fits, and it is judged
like any host, by the empty one; pages without outcome count nowhere; extra columns are ignored; repeated
rows are judged each, and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import Scratch

#: (verdict, host, path), fixed by the query's contract
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
THRESHOLD = 0.25
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 200.0
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(host, r":\d*$", ""), r"((?<![^.])(?:co|com|net|org|gov|edu|ac)\.[a-z]{2}|[^.]*)$", 1)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(host, r":\d*$", ""), r"([^.]*\.(?:(?:co|com|net|org|gov|edu|ac)\.[a-z]{2}|[^.]*)|[^.]*)$", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, f"{name}{start}") if rule is None else rule.when(fits, f"{name}{start}")
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def _strength(groups: DataFrame, mean: str, name: str) -> DataFrame:
    """One row: the prior strength fitted by moments over the labelled groups (n, y) around their means."""
    m = F.col(mean)
    noise = m * (1 - m)
    seen = groups.where("n > 1").agg(
        F.sum((F.col("y") - F.col("n") * m) * (F.col("y") - F.col("n") * m) - F.col("n") * noise).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("room"),
    )
    rho = F.coalesce(F.try_divide("excess", "room"), F.lit(0.0))
    fitted = F.when(rho <= 0, F.lit(MAX_STRENGTH)).when(rho >= 1, F.lit(MIN_STRENGTH)).otherwise((1 - rho) / rho)
    return seen.select(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), fitted)).alias(name))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, n, y, mean, low, high for every row of ``hosts``; ``outcomes`` has host and bad (0 or 1)."""
    scratch = Scratch(outcomes.sparkSession, "reputation")
    counted = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("y"))
    base = scratch.keep(hosts.join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0)).alias("y"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))
    domains = scratch.keep(base.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max("suffix").alias("suffix")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    world = suffixes.agg(((F.sum("y") + 1) / (F.sum("n") + 2)).alias("up"))
    level = scratch.keep(_posterior(suffixes.crossJoin(F.broadcast(world)), "suffix"))  # one row of totals
    level = scratch.keep(_posterior(domains.join(level.select("suffix", F.col("mean").alias("up")), "suffix"), "domain"))
    full = _posterior(base.join(level.select("domain", F.col("mean").alias("up")), "domain"), "host", bounds=True)
    return full


def _posterior(groups: DataFrame, key: str, bounds: bool = False) -> DataFrame:
    held = groups.crossJoin(F.broadcast(_strength(groups, "up", "strength")))  # one row
    a, b = F.col("strength") * F.col("up") + F.col("y"), F.col("strength") * (1 - F.col("up")) + F.col("n") - F.col("y")
    mean = a / (a + b)
    if not bounds:
        return held.select(key, mean.alias("mean"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return held.select(key, "n", "y", mean.alias("mean"), (mean - Z * deviation).alias("low"), (mean + Z * deviation).alias("high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``; ``outcomes``: page_id, bad."""
    url = F.col("url").cast("string")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = read.join(outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id").select("host", "bad")
    known = host_reputation(labelled, read.select("host").distinct())
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = known.select("host", F.when(F.col("low") > threshold, "block").otherwise("allow").alias("own"))
    return read.join(own, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"))


def outcomes_of_sources(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: a page shows the document whose number is in its path; low quality or toxic is bad."""
    number = F.regexp_extract(path_of(F.col("url").cast("string")), r"^/[^/]*/(\d{1,18})", 1)
    shown = pages.select("page_id", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    bad = F.greatest((1 - F.col("quality")).cast("int"), F.col("toxic").cast("int"))
    marked = labels.groupBy("doc_id").agg(F.max(bad).alias("bad")).where("bad is not null")
    return shown.join(marked, "doc_id").select("page_id", "bad")
