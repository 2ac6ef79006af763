"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 bad, 0 good) are counted a host.  A host's rate of bad pages has a beta prior
centred on the shrunken rate of its registered domain, the domain's on that of its suffix, and the
suffix's on the overall rate.  How strongly each level pulls is fitted by the method of moments for
beta-binomial counts.  A host is blocked when the lower posterior bound of its rate passes a limit.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged as the host
``''``; hosts without labelled pages get their domain's prior; with no labels at all the prior is the
Beta(1/2, 1/2) mean of 1/2 at the weakest strength, whose bound lies under the limit, so everything is
allowed.  Repeated rows are judged and counted each; null ids pass through; a long url is read whole; further
columns are ignored, whatever their names; an empty table gives no rows.
Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import cut

#: (verdict, rule): a rule is a host suffix and a path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Labels that make a two-label public suffix when a country code follows.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
BOUND_Z = 1.645
BLOCK_ABOVE = 0.5
#: Limits of the fitted correlation between two pages of one group; strength is 1/rho - 1.
RHO_LIMITS = (1e-4, 0.5)
#: Rules up to which they are compiled into one expression; more are joined by host suffix.
MAX_RULES = 500


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The last label, or the last two under a country code's second level."""
    two = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$"
    return F.coalesce(F.nullif(F.regexp_extract(host, two, 1), F.lit("")), F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with the label before it; a host that is a suffix is its own domain."""
    left = F.expr("substring({0}, 1, greatest(length({0}) - length({1}) - 1, 0))".format("host", "suffix"))
    return F.when(host == suffix, host).otherwise(F.concat(F.substring_index(left, ".", -1), F.lit("."), suffix))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        at = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(at & path.startswith(f"/{tail}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def with_rule(judged: DataFrame, rules=RULES, most: int = MAX_RULES) -> DataFrame:
    """``judged`` with the rule that fits host and path, the longest, of equally long ones the first in order."""
    if len(rules) <= most:
        return judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    table = [(name, f"/{tail}", rule) for _, rule in rules for name, _, tail in [rule.partition("/")]]
    table = judged.sparkSession.createDataFrame(table, "suffix string, tail string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = judged.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = places.join(table, "suffix").filter(F.col("path").startswith(F.col("tail")))
    best = fits.groupBy("host", "path").agg(F.min_by("rule", F.struct(-F.length("rule"), "rule")).alias("rule"))
    return judged.join(best, ["host", "path"], "left")


def _shrink(groups: DataFrame, prior: str, shrunk: str) -> DataFrame:
    """Adds the posterior mean (``shrunk``) and both beta parameters for counts n, k and a prior mean."""
    m = F.col(prior)
    v = m * (1 - m)
    fit = groups.agg(
        F.sum((F.col("k") - F.col("n") * m) ** 2 - F.col("n") * v).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * v).alias("pairs"),
    ).select(
        F.least(F.greatest(F.coalesce(F.col("over") / F.nullif(F.col("pairs"), F.lit(0.0)), F.lit(RHO_LIMITS[1])), F.lit(RHO_LIMITS[0])), F.lit(RHO_LIMITS[1])).alias("rho"),
    )
    s = 1 / fit.scalar() - 1
    return (
        groups.withColumn("alpha", F.col("k") + s * m)
        .withColumn("beta", F.col("n") - F.col("k") + s * (1 - m))
        .withColumn(shrunk, F.col("alpha") / (F.col("alpha") + F.col("beta")))
    )


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host's rate of bad pages.

    ``outcomes`` has ``host`` and ``bad`` (1, 0, or null where a page is not labelled).  Returns host,
    domain, suffix, n, k, rate and the lower bound.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = cut(hosts)  # what follows reads the counts often, never the pages
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).alias("m0"))
    suffixes = suffixes.withColumn("m0", overall.scalar())
    suffixes = cut(_shrink(cut(suffixes), "m0", "m1").select("suffix", "m1"))
    domains = cut(_shrink(cut(domains.join(suffixes, "suffix")), "m1", "m2").select("domain", "m2"))
    a, b = F.col("alpha"), F.col("beta")
    return _shrink(cut(hosts.join(domains, "domain")), "m2", "rate").select(
        "host", "domain", "suffix", "n", "k", "rate",
        (F.col("rate") - BOUND_Z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("bound"),
    )


def judge(pages: DataFrame, rules=RULES, outcome: str | None = None) -> DataFrame:
    """Every page's host, path, rule and verdict.

    A rule decides where one fits; elsewhere the host's reputation does.  ``outcome`` names a column of
    labels (1 bad, 0 good, null unknown); without it the pages that a rule decides are the labelled ones.
    """
    verdict = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else None
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        (F.col(outcome).cast("int") if outcome else F.lit(None).cast("int")).alias("given"),
    )
    judged = with_rule(judged, rules)
    judged = judged.withColumn("ruled", verdict[F.col("rule")] if rules else F.lit(None).cast("string"))
    bad = F.col("given") if outcome else F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    hosts = reputation(judged.select("host", bad.alias("bad"))).select("host", "bound")
    return judged.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bound") > BLOCK_ABOVE, "block").otherwise("allow")).alias("verdict"),
    )
