"""Empirical-Bayes host reputation for URLs, with path rules that override it.

Labelled page outcomes are counted per host. Counts shrink through three beta-binomial levels: the
suffix takes its prior from all labelled pages, the registered domain from its suffix, the host from
its domain. A level's prior has its parent's posterior mean; its strength, in pages, is estimated
from the data by the method of moments: how far the level's counts stray from their parents' means
beyond binomial chance tells how alike the members of one parent are. A host is blocked when the
lower quantile of its beta posterior for bad pages passes `block_above`. Everything is DataFrame
expressions.

Keys that hold more than 1 / HEAVY of all rows number at most HEAVY: what is known of them is
broadcast. All other keys join by shuffle. The tables of hosts, domains and suffixes are written
once each, since every level is read for its strength, its heavy keys and the level below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

HEAVY = 1000
#: Bounds of a level's estimated strength, and its value where the data say nothing.
STRENGTH, DEFAULT_STRENGTH = (0.5, 1000.0), 8.0
QUANTILE_STEPS = 128
#: Two-label public suffixes that are registered under, besides the last label itself.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx")


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty where there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to ? or #; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The label below the public suffix with that suffix; a bare suffix stays as it is."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*suffixes), three).otherwise(two)


def public_suffix(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (action, host/path) rule that fits, as a struct of rule and action; else null.

    A rule fits its host and the host's subdomains where the path starts with the rule's path. Rules
    are a parameter of the query and become one expression, longest rule first.
    """
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _posterior(bad: Column, n: Column, mean: Column, strength: Column) -> Column:
    return (bad + mean * strength) / (n + strength)


def _strength(counts: DataFrame, bad: str, n: str, mean: str, name: str) -> DataFrame:
    """One row: the strength of a level's prior by the method of moments, between the bounds of STRENGTH.

    With rho = 1 / (strength + 1), (bad - n mean)^2 has the expectation
    n mean (1 - mean) (1 + (n - 1) rho). Where no member has two pages, nothing tells them apart and
    the strength is DEFAULT_STRENGTH.
    """
    x, k, m = F.col(bad), F.col(n), F.col(mean)
    chance = F.sum(k * m * (1 - m))
    excess = F.sum((x - k * m) * (x - k * m)) - chance
    rho = excess / F.nullif(F.sum(k * (k - 1) * m * (1 - m)), F.lit(0.0))
    low, high = STRENGTH
    bounded = F.least(F.greatest(rho, F.lit(1 / (high + 1))), F.lit(1 / (low + 1)))
    return counts.agg(F.coalesce(1 / bounded - 1, F.lit(DEFAULT_STRENGTH)).alias(name))


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """The p-quantile of Beta(a, b), by the midpoint rule on QUANTILE_STEPS angles.

    With x = sin(t)^2 the density of t is sin(t)^(2a-1) cos(t)^(2b-1), smooth and nearly normal with
    standard deviation 1 / (2 sqrt(a + b + 1)); the angles cover eight of these on both sides of the
    mean. 0 for a = 0, else 1 for b = 0.
    """
    half = math.pi / 2
    centre = F.asin(F.sqrt(a / (a + b)))
    reach = 4 / F.sqrt(a + b + 1)
    frame = F.struct(F.greatest(centre - reach, F.lit(0.0)).alias("from"), F.least(centre + reach, F.lit(half)).alias("to"), a.alias("a"), b.alias("b"), centre.alias("centre"))
    log_density = lambda f, t: (f["a"] * 2 - 1) * F.ln(F.sin(t)) + (f["b"] * 2 - 1) * F.ln(F.cos(t))

    def weighed(f: Column) -> Column:
        step = (f["to"] - f["from"]) / QUANTILE_STEPS
        top = log_density(f, f["from"] + step * (QUANTILE_STEPS // 2 + 0.5))
        g = F.transform(F.sequence(F.lit(0), F.lit(QUANTILE_STEPS - 1)), lambda i: F.exp(log_density(f, f["from"] + step * (i + 0.5)) - top))
        return F.struct(f["from"].alias("from"), step.alias("step"), g.alias("g"))

    def found(w: Column) -> Column:
        goal = F.aggregate(w["g"], F.lit(0.0), lambda s, x: s + x) * p
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"))
        # Whole steps below the goal, and the part of the step in which it is reached.
        walk = F.aggregate(w["g"], start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (goal - s["sum"]) / x))).alias("at")))
        angle = F.sin(w["from"] + walk["at"] * w["step"])
        return angle * angle

    one = lambda c, f: F.transform(F.array(c), f)  # noqa: E731  each step is evaluated once
    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(F.element_at(one(F.element_at(one(frame, weighed), 1), found), 1))


def _lookup(rows: DataFrame, key: str, table: DataFrame, size: str) -> DataFrame:
    """`rows` with the columns of `table` (one row a key, `size` its rows in `rows`) by an inner join.

    Heavy keys' entries are broadcast; rows of heavy keys don't take part in the shuffle's key.
    """
    total = table.agg(F.sum(size).alias("_all"))
    t = table.join(F.broadcast(total)).withColumn("_heavy", F.col(size) * HEAVY > F.col("_all")).drop("_all", size)
    values = [c for c in table.columns if c not in (key, size)]
    heavy = t.where("_heavy").select(key, F.struct(*values).alias("_big"))
    light = t.where("NOT _heavy").select(F.col(key).alias("_key"), F.struct(*values).alias("_small"))
    r = rows.join(F.broadcast(heavy), key, "left").withColumn("_key", F.when(F.col("_big").isNull(), F.col(key)))
    small = r.where("_key IS NOT NULL").join(light, "_key")
    out = small.unionByName(r.where("_key IS NULL").withColumn("_small", F.lit(None).cast(light.schema["_small"].dataType)))
    return out.withColumns({v: F.coalesce(F.col(f"_big.{v}"), F.col(f"_small.{v}")) for v in values}).drop("_key", "_big", "_small")


def host_reputation(hosts: DataFrame, p: float = 0.05) -> DataFrame:
    """(host, pages, bad_mean, bad_lower) from (host, bad, n, pages): posterior mean and p-quantile of the bad share.

    Counts roll up to domain and suffix by partial sums. No labelled page at all: prior mean 0.
    """
    h = hosts.select("host", registered_domain(F.col("host")).alias("domain"), public_suffix(F.col("host")).alias("suffix"), "bad", "n", "pages")
    domains = checkpointed(h.groupBy("domain", "suffix").agg(F.sum("bad").alias("d_bad"), F.sum("n").alias("d_n"), F.count(F.lit(1)).alias("d_hosts")))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_n").alias("s_n"), F.count(F.lit(1)).alias("s_domains"))
    total = suffixes.agg(F.coalesce(F.sum("s_bad") / F.nullif(F.sum("s_n"), F.lit(0)), F.lit(0.0)).alias("m0"))
    suffixes = checkpointed(suffixes.join(F.broadcast(total)))
    suffixes = suffixes.join(F.broadcast(_strength(suffixes, "s_bad", "s_n", "m0", "k")))
    suffixes = checkpointed(suffixes.select("suffix", "s_domains", _posterior(F.col("s_bad"), F.col("s_n"), F.col("m0"), F.col("k")).alias("m1")))
    domains = checkpointed(_lookup(domains, "suffix", suffixes, "s_domains"))
    domains = domains.join(F.broadcast(_strength(domains, "d_bad", "d_n", "m1", "k")))
    domains = checkpointed(domains.select("domain", "d_hosts", _posterior(F.col("d_bad"), F.col("d_n"), F.col("m1"), F.col("k")).alias("m2")))
    h = checkpointed(_lookup(h.select("host", "domain", "bad", "n", "pages"), "domain", domains, "d_hosts"))
    h = h.join(F.broadcast(_strength(h, "bad", "n", "m2", "k")))
    h = h.select("host", "pages", (F.col("bad") + F.col("m2") * F.col("k")).alias("a"), (F.col("n") - F.col("bad") + (1 - F.col("m2")) * F.col("k")).alias("b"))
    return h.select("host", "pages", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_mean"), beta_quantile(F.col("a"), F.col("b"), p).alias("bad_lower"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", p: float = 0.05, block_above: float = 0.2) -> DataFrame:
    """Judge each URL: page_id, host, path, rule, verdict, bad_mean, bad_lower.

    `outcomes` has (page_id, bad 0/1); null ids or outcomes are left out, and of repeated ids the
    worst counts. A rule's action comes first, that of the longest rule that fits (of equally long
    ones the greatest by code point); else the host's posterior quantile decides. A null URL or one
    without :// has empty host and path; such pages share the reputation of the empty host. Repeated
    page rows are judged each, and count each; pages with a null id have no outcome. Other columns
    are ignored; an empty table gives no rows.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    d = d.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    told = d.where("page_id IS NOT NULL").join(seen, "page_id", "left").select("host", "bad")
    told = told.unionByName(d.where("page_id IS NULL").select("host", F.lit(None).cast(seen.schema["bad"].dataType).alias("bad")))
    hosts = checkpointed(told.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"), F.count(F.lit(1)).alias("pages")))
    judged = _lookup(d, "host", checkpointed(host_reputation(hosts, p)), "pages")
    hit = rule_match(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(hit["action"], F.when(F.col("bad_lower") > block_above, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", hit["rule"].alias("rule"), verdict.alias("verdict"), F.round("bad_mean", 9).alias("bad_mean"), F.round("bad_lower", 7).alias("bad_lower"))
