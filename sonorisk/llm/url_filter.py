"""URL filters by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted per host and shrunk through beta-binomial priors: the corpus gives
the prior of a suffix, the suffix that of a registered domain, the domain that of a host.  A url that no
rule decides is blocked when the lower bound of its host's posterior bad rate exceeds ``max_bad_rate``.

Scale: pages are reduced to (host, counts) with map-side combine, and every later level is made from the
level below it.  The host table is checkpointed, so that the join back to the pages has an exchange on
both sides and Spark can split a host that holds a third of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sonorisk.llm.common import ascii_lower, beta_prior, nested, reliable

# Public suffixes of more than one label, and the names that RFC 2606 sets aside for
# documentation, under which sites register as under a suffix.
LONG_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.za", "com.br",
    "com.mx", "com.ar", "com.cn", "com.tr", "example.com", "example.net", "example.org",
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is ``host/path``; it fits the host and its subdomains when the url's path starts with the path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for NULL."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://`` or for NULL."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits (first of equal length), else NULL.  The rules are a literal list."""
    out = F.lit(None).cast("int")
    for k, r in sorted(enumerate(rules), key=lambda x: (len(x[1].pattern), -x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix and one label more; a host that is a bare suffix is its own domain."""
    three, two = F.substring_index(host, ".", -3), F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), three).otherwise(two)


def host_reputation(hosts: DataFrame, z: float = 1.645, low: float = 1.0, high: float = 1000.0, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``host, n, bad`` (one row per host) to ``host, n_labelled, n_bad, rep_mean, rep_bound``.

    ``rep_mean`` is the posterior mean of the bad rate and ``rep_bound`` its lower bound, mean - z * sd.
    Hosts without labels get their domain's prior; an empty table gives an empty one.
    """
    hosts = reliable(hosts.select("host", "n", "bad", domain_of(F.col("host"), long_suffixes).alias("domain"), suffix_of(F.col("host"), long_suffixes).alias("suffix")))
    domains = reliable(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top, k_suffix = beta_prior(suffixes, low, high)
    (_, k_domain), (_, k_host) = beta_prior(domains, low, high), beta_prior(hosts, low, high)

    def post(prior: Column, k: float) -> Column:
        return (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))

    s = reliable(suffixes.select("suffix", post(F.lit(float(top)), k_suffix).alias("m_suffix")))
    d = reliable(domains.join(s, "suffix").select("domain", post(F.col("m_suffix"), k_domain).alias("m_domain")))
    mean, total = F.col("rep_mean"), F.col("n") + F.lit(k_host)
    return (
        hosts.join(d, "domain")
        .withColumn("rep_mean", post(F.col("m_domain"), k_host))
        .select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "rep_mean", (mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (total + 1))).alias("rep_bound"))
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], max_bad_rate: float = 0.5, z: float = 1.645,
    keep: Sequence[str] | None = ("page_id",), page_id: str = "page_id", url: str = "url",
) -> DataFrame:
    """Allow or block every page.

    ``outcomes``: ``page_id, bad`` (0/1), any number of rows a page; a page is bad if one of them is.  Rows with a
    NULL id or outcome teach nothing.  Returns ``doc`` (the kept input columns), ``host, path, rule, verdict`` and the
    host's ``n_labelled, n_bad``.  A NULL url, or one without ``://``, has an empty host, which is judged like any
    other host.  Repeated pages are judged, and count, once a row.  No pages: no rows.
    """
    base = nested(pages, keep, pid=page_id, url=url).select("doc", "pid", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select(F.col("page_id").alias("pid"), F.col("bad").cast("long").alias("bad")).filter("pid is not null and bad is not null").groupBy("pid").agg(F.max("bad").alias("bad"))
    hosts = base.select("pid", "host").join(known, "pid", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rep = reliable(host_reputation(hosts, z))
    rule = F.col("rule_no")
    names = F.array(*[F.lit(r.pattern) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    return (
        base.withColumn("rule_no", matching_rule(F.col("host"), F.col("path"), rules))
        .join(rep, "host", "left")
        .select(
            "doc", "host", "path", F.get(names, rule).alias("rule"),
            F.coalesce(F.get(verdicts, rule), F.when(F.col("rep_bound") > F.lit(max_bad_rate), "block").otherwise("allow")).alias("verdict"),
            "n_labelled", "n_bad",
        )
    )
