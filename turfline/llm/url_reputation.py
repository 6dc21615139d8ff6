"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix.  The bad rate of a suffix is shrunk towards
that of all pages, a domain's towards its suffix's, a host's towards its domain's: each level is a beta-binomial model whose prior
has the parent's posterior mean and a strength estimated by the method of moments from how the level's groups
scatter around their parents.  A url is blocked if the lower bound of its host's posterior (mean - ``BOUND`` standard deviations)
exceeds ``BAD_RATE``; hosts without labels have their domain's posterior mean.

Counts combine before the shuffle, so a host with a third of all pages is one row for each task.  Null or malformed urls have the
empty host and path and are judged as that host.  Outcomes without an id count nowhere; repeated rows count each.  Without any
outcome nothing is blocked.  Extra columns are ignored by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.session import stage

BAD_RATE = 0.5
BOUND = 1.645
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 10_000.0)
#: Second labels that make a public suffix with a country code (fixed values); used where no table of suffixes is given.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
#: The suffix of all numeric addresses, each of which is its own domain.
ADDRESS = "address"
#: Rules are literals of the plan; so many at most.
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule (verdict, host/path) that fits ``host`` and ``path``, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else reduce(lambda _, x: x, found, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def named(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row for each host) with ``suffix`` and registered ``domain``.

    ``suffixes`` (suffix string) lists public suffixes; the longest that fits counts.  Without it, or where none fits, the suffix is the last label, or the
    last two if they are a general second label and a country code.  A port is not part of either.
    """
    name = F.regexp_replace("host", ":[0-9]*$", "")
    last = F.substring_index("_name", ".", -1)
    two = F.substring_index("_name", ".", -2)
    country = two.rlike(rf"^(?:{'|'.join(SECOND_LABELS)})\.[a-z][a-z]$")
    out = hosts.withColumn("_name", name).withColumn("_suffix", F.when(country, two).otherwise(last))
    if suffixes is not None:
        labels = F.split("_name", r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        known = suffixes.select(F.lower("suffix").alias("tail")).where("tail <> ''").distinct()
        longest = out.select("host", F.explode(tails).alias("tail")).join(known, "tail").groupBy("host").agg(F.max_by("tail", F.length("tail")).alias("_listed"))
        out = out.join(longest, "host", "left").withColumn("_suffix", F.coalesce("_listed", "_suffix")).drop("_listed")
    dots = F.size(F.split("_suffix", r"\."))
    domain = F.array_join(F.slice(F.split("_name", r"\."), -F.least(dots + 1, F.size(F.split("_name", r"\."))), dots + 1), ".")
    address = F.col("_name").rlike(r"^[0-9.]*[0-9]$|^\[")
    return out.select(*hosts.columns, F.when(address, ADDRESS).otherwise(F.col("_suffix")).alias("suffix"), F.when(address, F.col("_name")).otherwise(domain).alias("domain"))


def _strength(groups: DataFrame) -> float:
    """The prior's strength k = 1 / rho - 1 for groups (n, bad, prior), by the method of moments; one row comes to the driver."""
    wide = F.col("prior") * (1 - F.col("prior"))
    r = groups.where("n > 0 AND prior > 0 AND prior < 1").agg(
        F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2 / F.col("n") / wide).alias("scatter"), F.count("*").alias("m"), F.sum("n").alias("n")).first()
    if not r.m or r.n <= r.m:
        return STRENGTH[0]
    rho = (r.scatter - r.m) / (r.n - r.m)
    return min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1)) if rho > 0 else STRENGTH[1]


def _shrunk(groups: DataFrame) -> DataFrame:
    """``mean`` and ``weight`` (pages and prior together) of the posterior of groups (n, bad, prior)."""
    k = F.lit(_strength(groups))
    return groups.withColumn("mean", (F.col("bad") + F.col("prior") * k) / (F.col("n") + k)).withColumn("weight", F.col("n") + k)


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, mean, low): posterior mean and lower bound for every host of ``outcomes`` (host, n, bad), one row for each."""
    hosts = stage(named(outcomes, suffixes), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(*sums).first()
    base = total.bad / total.n if total.n else 0.0
    suffixes = _shrunk(stage(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(base)), "suffixes"))
    domains = _shrunk(stage(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "domains"))
    found = _shrunk(stage(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]), "host-priors"))
    low = F.col("mean") - BOUND * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return found.select("host", "mean", low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = BAD_RATE,
          suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url); ``outcomes``: (page_id, bad boolean).

    Of rules of equal length that fit, the one that sorts last is taken, and of equal ones 'block'.
    """
    split = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    counts = split.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stage(reputation(counts, suffixes).withColumn("blocked", F.col("low") > limit).select("host", "blocked"), "reputation")
    ruled = split.withColumn("found", matching_rule(rules)).join(hosts, "host", "left")
    said = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", said).alias("verdict"))
