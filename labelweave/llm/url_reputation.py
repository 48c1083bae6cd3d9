"""URL filter by host reputation: beta-binomial shrinkage from suffix to registered domain to host."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import lower_az, stored

#: Second-level labels that count as part of a public suffix below a country code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits the host, or a parent of it, and the start of the path; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, rule).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """Public suffix of a host without port: last label, or the last two below a country code; empty for addresses."""
    labels = F.split(host, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    country = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    return (
        F.when(last.rlike("^[0-9]*$"), "").when(country, F.concat_ws(".", second, last)).otherwise(last)
    )


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label more, or the whole host where there is none."""
    more = F.regexp_extract(F.expr("left(host, greatest(length(host) - length(suffix) - 1, 0))"), r"([^.]+)$", 1)
    return F.when((suffix == "") | (more == ""), host).otherwise(F.concat_ws(".", more, suffix))


def strength(groups: DataFrame) -> tuple[float, float]:
    """Overall bad rate and prior strength of groups (n, bad), by moments of the beta-binomial."""
    row = groups.filter("n > 0").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"),
    ).first()
    if not row["n"]:
        return 0.5, 1.0
    m, n = row["m"], float(row["n"])
    rate = row["bad"] / n
    binomial = rate * (1 - rate)
    spread = binomial * (n - row["nn"] / n - (m - 1))
    within = (row["kk"] - row["bad"] * row["bad"] / n - binomial * (m - 1)) / spread if spread > 0 else 0.0
    correlation = min(max(within, 0.001), 0.5)
    return rate, 1 / correlation - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host's bad rate from rows (host, n, bad), one per host.

    Returns host, n, bad, alpha, beta. The prior of a host is centred on its registered domain, that of a domain on its
    suffix, that of a suffix on the overall rate. Prior strengths are fitted per level over all groups. Hosts with no
    labelled page have the prior of their domain; with no label at all the prior is one half.
    """
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    tree = (
        outcomes.select("host", "n", "bad", bare.alias("name"))
        .withColumn("suffix", suffix_of(F.col("name")))
        .select("host", "n", "bad", "suffix", F.col("name"))
    )
    named = tree.select(F.col("host").alias("key"), F.col("name").alias("host"), "suffix", "n", "bad")
    tree = stored(named.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))).drop("host"), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = tree.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    rate, s_suffix = strength(suffixes)
    _, s_domain = strength(domains)
    _, s_host = strength(tree)

    def mean(prior: Column, weight: float) -> Column:
        return (F.col("bad") + prior * weight) / (F.col("n") + weight)

    suffix_mean = suffixes.select("suffix", mean(F.lit(rate), s_suffix).alias("suffix_mean"))
    domain_mean = domains.join(suffix_mean, "suffix").select(
        "suffix", "domain", mean(F.col("suffix_mean"), s_domain).alias("domain_mean")
    )
    prior = F.col("domain_mean")
    return tree.join(domain_mean, ["suffix", "domain"]).select(
        F.col("key").alias("host"), "n", "bad",
        (prior * s_host + F.col("bad")).alias("alpha"),
        ((1 - prior) * s_host + F.col("n") - F.col("bad")).alias("beta"),
    )


def lower_bound(z: float) -> Column:
    """Mean less ``z`` standard deviations of the posterior (alpha, beta)."""
    a, b = F.col("alpha"), F.col("beta")
    total = a + b
    return a / total - z * F.sqrt(a * b / (total * total * (total + 1)))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    max_bad: float = 0.3,
    z: float = 1.645,
) -> DataFrame:
    """Allow or block every page by a rule for its URL, else by the reputation of its host.

    ``pages`` has page_id and url, ``labels`` page_id and bad (boolean, null: no outcome). A page with several labels is
    bad if any says so. A host is blocked when the lower credible bound of its bad rate is above ``max_bad``.
    Returns page_id, host, path, rule, verdict, n_labelled, bad_bound, one row per row of ``pages``. A null or odd URL has
    an empty host, which is a host like any other. Null ids find no label. Empty tables give no rows; without labels
    nothing is blocked but by rules. Other columns are ignored.
    """
    if not math.isfinite(z):
        raise ValueError("z must be finite")
    outcome = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"))
    hosts = (
        seen.join(outcome, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    )
    bound = stored(
        reputation(hosts).select("host", F.col("n").alias("n_labelled"), lower_bound(z).alias("bad_bound")), "reputation"
    )
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    said = F.lit(None).cast("string")
    for verdict, name in rules:
        said = F.when(F.col("rule") == name, verdict).otherwise(said)
    by_host = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return (
        parts.withColumn("rule", rule)
        .join(bound, "host", "left")
        .select(
            "page_id", "host", "path", "rule", F.coalesce(said, by_host).alias("verdict"), "n_labelled",
            F.round("bad_bound", 9).alias("bad_bound"),
        )
    )
