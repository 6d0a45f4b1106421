"""Reputation of web hosts by empirical Bayes.

Labelled page outcomes (good or bad) are counted per host, summed to the registered domain
and to the public suffix. Each level's rate of good pages is a beta prior for the level
below: suffixes shrink to the rate of all pages, domains to their suffix, hosts to their
domain. A host without outcomes has its domain's rate, else its suffix's, else that of all
pages. A host passes if an upper or lower bound of its posterior allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import written

# Public suffixes of two labels; all others are taken to have one.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
    "co.nz", "org.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "com.sg",
)

Z = 1.645  # one-sided 95 %
LEAST_RATE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for null and for urls without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last two labels if they are known as one, else the last."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label before it (the host itself if there is none)."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _posterior(df: DataFrame, prior: Column, strength: Column, name: str) -> DataFrame:
    """Adds the posterior's parameters a and b under a beta prior of this mean and strength."""
    return df.withColumns(
        {
            f"{name}_a": prior * strength + F.col("good"),
            f"{name}_b": (1 - prior) * strength + F.col("n") - F.col("good"),
        }
    )


def _strength(level: DataFrame, parent: Column) -> float:
    """How many pages the prior of a level weighs, by moments. With p the parent's rate and r a
    child's rate over n pages, E[(r - p)^2] = p (1 - p) (1 + rho (n - 1)) / n; the strength is
    1 / rho - 1, kept between 1 and 10,000."""
    p = F.least(F.greatest(parent, F.lit(1e-6)), F.lit(1 - 1e-6))
    chance = p * (1 - p)
    over = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2) - chance)
    room = F.sum(chance * (F.col("n") - 1))
    rho = F.when(room > 0, over / room).otherwise(F.lit(0.0))
    return level.agg(F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e4))).first()[0]


def host_reputation(outcomes: DataFrame, z: float = Z, others: DataFrame | None = None) -> DataFrame:
    """(host, domain, suffix, n, good, rate, lower, upper) of every host with outcomes, and of
    the hosts in ``others`` (host) that have none: their n is 0 and their posterior the prior.

    A prior that skips levels weighs no more than the weakest of those it skips, as the
    domains of a suffix differ more than the hosts of a domain.

    outcomes: (host, good boolean); rows with a null in either are no outcome. Without
    outcomes the table is empty. Rates and strengths are fitted on outcomes alone. Each level is summed from the one below, so a host that holds
    a third of all pages is one row after the first, partly map-side, sum. rate is the
    posterior's mean; the bounds lie z standard deviations from it.
    """
    # Hosts are counted once and written; what is fitted to a level comes to the driver as one number.
    known = outcomes.where(F.col("host").isNotNull() & F.col("good").isNotNull()).select("host", F.col("good").cast("long").alias("good"))
    if others is not None:
        known = known.unionAll(others.where(F.col("host").isNotNull()).select("host", F.lit(None).cast("long")))
    counted = known.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    suffix = suffix_of(F.col("host"))
    hosts = written(counted.select("host", domain_of(F.col("host"), suffix).alias("domain"), suffix.alias("suffix"), "n", "good"))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    judged = hosts.where("n > 0")
    suffixes = written(judged.groupBy("suffix").agg(*sums))
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    if not n:
        none = [F.lit(None).cast("double").alias(c) for c in ("rate", "lower", "upper")]
        return hosts.where("false").select("host", "domain", "suffix", "n", "good", *none)
    all_rate = F.lit((good + 1) / (n + 2))
    suffix_strength = _strength(suffixes, all_rate)
    suffixes = _posterior(suffixes, all_rate, F.lit(suffix_strength), "suffix")
    above_domains = suffixes.select("suffix", (F.col("suffix_a") / (F.col("suffix_a") + F.col("suffix_b"))).alias("suffix_rate"))

    domains = written(judged.groupBy("domain", "suffix").agg(*sums).join(above_domains, "suffix"))
    domain_strength = _strength(domains, F.col("suffix_rate"))
    domains = _posterior(domains, F.col("suffix_rate"), F.lit(domain_strength), "domain")
    above = domains.select("domain", "suffix", (F.col("domain_a") / (F.col("domain_a") + F.col("domain_b"))).alias("domain_rate"))

    hosts = written(hosts.join(above, ["domain", "suffix"], "left").join(above_domains, "suffix", "left"))
    strength = _strength(hosts.where("n > 0"), F.col("domain_rate"))
    of_host = F.when(F.col("domain_rate").isNotNull(), strength)
    of_host = of_host.when(F.col("suffix_rate").isNotNull(), min(strength, domain_strength))
    hosts = hosts.withColumns(
        {
            "strength": of_host.otherwise(min(strength, domain_strength, suffix_strength)),
            "domain_rate": F.coalesce("domain_rate", "suffix_rate", all_rate),
        }
    )
    hosts = _posterior(hosts, F.col("domain_rate"), F.col("strength"), "host")
    a, b = F.col("host_a"), F.col("host_b")
    rate = a / (a + b)
    spread = z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select(
        "host", "domain", "suffix", "n", "good", rate.alias("rate"),
        F.greatest(rate - spread, F.lit(0.0)).alias("lower"), F.least(rate + spread, F.lit(1.0)).alias("upper"),
    )


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (both null if none does). rules: (verdict,
    host + path); a rule fits its host and all subdomains where the path starts with its own."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones win
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_pages(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]] = (),
    *,
    page_id: str = "page_id",
    url: str = "url",
    least_rate: float = LEAST_RATE,
    z: float = Z,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n, rate, lower, upper), one row per row of pages.

    outcomes: (page_id, good boolean). Without a rule that fits, a page is blocked if even
    the upper bound of its host's rate of good pages is below ``least_rate``: few outcomes
    leave a wide bound, so that unknown hosts pass. Null urls and urls without ``://``
    have an empty host, which is judged like any other; null page_ids stay, without an
    outcome. A page with several outcomes counts with each; pages that repeat are judged
    alike. Hosts without outcomes have n = 0 and are judged by the prior that their domain,
    suffix or all pages give; n, rate and bounds are null, and pages without a rule allowed,
    only if there is no outcome at all.
    """
    judged = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")
    )
    known = outcomes.select(F.col("page_id").alias("page_id"), F.col("good").cast("boolean").alias("good"))
    reputation = host_reputation(judged.select("page_id", "host").join(known, "page_id"), z, judged)
    rule, ruled = rule_for(F.col("host"), F.col("path"), list(rules))
    own = F.when(F.col("upper") < least_rate, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(reputation.drop("domain", "suffix", "good"), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "n", "rate", "lower", "upper"
    )
