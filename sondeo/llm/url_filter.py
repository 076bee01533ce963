"""URL filter by empirical-Bayes host reputation, overruled by explicit rules.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is a beta-binomial model whose
prior mean is the posterior mean of the level above and whose prior strength is fitted by moments over the level; a
host is allowed if the lower bound of its posterior is high enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import ascii_lower, quoted, stored, without

MIN_GOOD = 0.5
Z = 1.645
MIN_RHO, MAX_RHO = 0.0001, 0.5
#: Second-level names that form a public suffix with a two-letter country.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
_SUFFIX = rf"(?:^|\.)((?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$"
_DOMAIN = rf"([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a bare name or an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$|^\[|^[^.]*$")
    domain = F.regexp_extract(name, _DOMAIN, 1)
    suffix = F.regexp_extract(name, _SUFFIX, 1)
    return F.when(address | (domain == ""), name).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def _level(groups: DataFrame, key: str, prior: DataFrame | None, on: str | None) -> DataFrame:
    """Posterior of each group of a level: (key, mean, weight). ``groups`` has n and k, the good among them.

    Rows per group; the strength is one number over them, joined back as a one-row table.
    """
    if prior is None:
        top = groups.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
        groups = groups.join(F.broadcast(top))
    else:
        groups = groups.join(prior.select(on, F.col("mean").alias("m")), on)
    v = F.col("m") * (1 - F.col("m"))
    seen = F.col("n") > 0
    off = F.sum(F.when(seen, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), F.lit(2.0)) - v))
    room = F.sum(F.when(seen, (F.col("n") - 1) * v))
    rho = F.coalesce(F.least(F.greatest(F.when(room > 0, off / room), F.lit(MIN_RHO)), F.lit(MAX_RHO)), F.lit(MIN_RHO))
    strength = groups.agg(rho.alias("rho")).select(((1 - F.col("rho")) / F.col("rho")).alias("s"))
    return groups.join(F.broadcast(strength)).select(
        *[c for c in groups.columns if c not in ("m", "n", "k")],
        (F.col("s") + F.col("n")).alias("weight"),
        ((F.col("s") * F.col("m") + F.col("k")) / (F.col("s") + F.col("n"))).alias("mean"),
    )


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """(host, mean, bound) for a table of (host, n, k): labelled pages of each host and the good among them.

    ``bound`` is the posterior mean less ``z`` posterior standard deviations. Hosts without labels take their
    domain's, suffix's or the overall rate. Hosts must be distinct and not null. Each level is stored, as two passes of
    the next one read it.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix_level = stored(_level(suffixes, "suffix", None, None), "suffix_level")
    domain_level = stored(_level(domains, "domain", suffix_level, "suffix").drop("suffix"), "domain_level")
    host_level = _level(hosts.drop("suffix"), "host", domain_level, "domain")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return host_level.select("host", "mean", (F.col("mean") - z * sd).alias("bound"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits, as a struct (rule, verdict); null if none does."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    min_good: float = MIN_GOOD,
    z: float = Z,
) -> DataFrame:
    """Add host, path, rule, verdict and the host's posterior ``bound`` to ``pages`` (page_id, url, ...).

    ``outcomes`` has (page_id, good 0/1). Rules are (allow or block, ``host/path``) and overrule reputation. A
    page is counted once per row of ``pages``; several outcomes of a page count as their least. Null outcomes
    and null ids are unlabelled. A null url, or one without ``://``, has an empty host and path, which is a host
    like any other. Input columns with the names of the result are replaced. Empty tables give empty ones; without
    labels every host has the rate 1/2 of the flat prior. The pages are read twice, for the counts and for the verdicts.
    """
    added = ("host", "path", "rule", "verdict", "bound")
    pages = without(pages, *added)
    names = [quoted(c) for c in pages.columns]
    judged = pages.select(*names, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    good = (
        outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull())
        .groupBy("page_id")
        .agg(F.min(F.col("good").cast("long")).alias("_good"))
    )
    counts = (
        judged.select("page_id", "host")
        .join(good, "page_id", "left")
        .groupBy("host")
        .agg(F.count("_good").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("k"))
    )
    found = rule_for(F.col("host"), F.col("path"), rules)
    return (
        judged.join(host_reputation(stored(counts, "host_counts"), z).select("host", "bound"), "host")
        .withColumn("_rule", found)
        .select(
            *names, "host", "path",
            F.col("_rule.rule").alias("rule") if rules else F.lit(None).cast("string").alias("rule"),
            F.coalesce(*([F.col("_rule.verdict")] if rules else []), F.when(F.col("bound") >= min_good, "allow").otherwise("block")).alias("verdict"),
            "bound",
        )
    )
