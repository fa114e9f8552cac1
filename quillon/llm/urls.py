"""URL filter by host reputation: empirical-Bayes shrinkage from host to registered domain to suffix.

Labelled page outcomes are counted for each host. Each level has a beta prior whose mean is its parent's posterior mean and
whose strength is a moment estimate of the beta-binomial's dispersion at that level; a page passes if the lower bound of
its host's posterior does. Written rules come first. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, fresh, staged

# Public suffixes of two labels that the registered domain stands before; all others have one.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "org.au", "org.uk"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower bound at so many standard deviations below the posterior mean; a page passes at THRESHOLD.
Z, THRESHOLD = 1.6449, 0.6
#: Strengths of priors, in pages, are kept between these.
WEAKEST, STRONGEST = 1.0, 10_000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path written as one) that fits, and its verdict; nulls if none does. A rule fits its host
    and all subdomains if the path starts with the rule's. rules are a written list: they become one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = text.find("/") if "/" in text else len(text)
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an IPv4 address is its own domain, without suffix."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    ip = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(name, ".", -2)
    n = F.when(two.isin(TWO_LABEL_SUFFIXES), 2).otherwise(1)
    suffix = F.when(ip, "").when(n == 2, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(ip, name).when(n == 2, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def strength(units: DataFrame) -> Column:
    """Prior strength from units with n, k, parent's mean m: the moment estimate of the intraclass correlation."""
    n, k, m = F.col("n").cast("double"), F.col("k").cast("double"), F.col("m")
    spread = F.sum(n * F.pow(k / n - m, 2)) / F.nullif(F.sum(n * m * (1 - m)), F.lit(0.0)) * F.sum(n)
    units_, total, squares = F.count("*"), F.sum(n), F.sum(n * n)
    free = total - squares / total - (units_ - 1)
    rho = (spread - (units_ - 1)) / F.nullif(free, F.lit(0.0))
    found = F.when(rho > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / rho - 1))).otherwise(F.lit(STRONGEST))
    return F.coalesce(found, F.lit(STRONGEST))


def reputations(counts: DataFrame) -> DataFrame:
    """host, mean and bound from host, n (labelled pages), k (good ones). Hosts without labels take their domain's prior,
    domains their suffix's, suffixes the overall mean (without any label 0.5)."""
    domain, suffix = levels(F.col("host"))
    hosts = staged(counts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    units, parent = suffixes.withColumn("m", F.lit(k / n if n else 0.5)), None
    for level, keys in (("suffix", ["suffix"]), ("domain", ["domain", "suffix"]), ("host", ["host"])):
        if level == "domain":
            units = domains.join(broadcast_below(parent, 50_000), "suffix")
        elif level == "host":
            units = hosts.join(broadcast_below(parent, 50_000), ["domain", "suffix"])
        s = units.where("n > 0").agg(strength(units)).first()[0]
        a, b = F.col("k") + s * F.col("m"), F.col("n") - F.col("k") + s * (1 - F.col("m"))
        parent = units.select(*keys, (a / (a + b)).alias("m"), (a + b).alias("weight"))
    return parent.select("host", F.col("m").alias("mean"), (F.col("m") - Z * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("weight") + 1))).alias("bound"))


def _judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id: str, url: str, outcome_id: str, good: str, threshold: float) -> tuple[DataFrame, dict[str, str]]:
    """Every row of pages with host, path, rule, verdict and bound, under names that pages doesn't have; and these names."""
    name = {}
    for x in ("host", "path", "rule", "verdict", "bound"):
        name[x] = fresh(pages, x)
    u = F.col(f"`{url}`")
    parts = pages.withColumns({name["host"]: host_of(u), name["path"]: path_of(u)})
    host = F.col(name["host"])
    rule, said = rule_of(host, F.col(name["path"]), rules)
    label = outcomes.where(F.col(f"`{good}`").isNotNull()).groupBy(F.col(f"`{outcome_id}`").alias("id")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(f"`{good}`") == 1, 1).otherwise(0)).alias("k"))
    seen = parts.select(F.col(f"`{id}`").alias("id"), host.alias("host"))
    counts = seen.join(label, "id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    table = staged(reputations(counts).select(F.col("host").alias(name["host"]), F.col("bound").alias(name["bound"])), "reputations")
    found = parts.join(broadcast_below(table, 200_000), name["host"], "left")
    verdict = F.coalesce(said, F.when(F.col(name["bound"]) >= threshold, "allow").otherwise("block"))
    return found.withColumns({name["rule"]: rule, name["verdict"]: verdict}), name


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", outcome_id: str = "doc_id", good: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, bound of each page. outcomes: labels (1 good, else bad; null labels and ids don't
    count) of pages by id, each label of a page counted.

    Every row of pages is returned once, repeated ones too. Null urls and urls without :// share the host ''. With no
    outcome at all every host has mean 0.5."""
    found, name = _judged(pages.select(F.col(f"`{id}`"), F.col(f"`{url}`")), outcomes, rules, id, url, outcome_id, good, threshold)
    return found.select(F.col(f"`{id}`"), *[F.col(name[x]).alias(x) for x in ("host", "path", "rule", "verdict", "bound")])


def keep(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", outcome_id: str = "doc_id", good: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The allowed rows of pages, all columns. Each row is judged by its own url, also where rows share an id or have none."""
    found, name = _judged(pages, outcomes, rules, id, url, outcome_id, good, threshold)
    return found.where(F.col(name["verdict"]) == "allow").select(*[F.col(f"`{c}`") for c in pages.columns])
