"""URL filter: rules first, else the reputation of the host by empirical Bayes.

Labelled pages (good or bad) are counted per host, registered domain and suffix. The good rate of a suffix is shrunk towards
the corpus, that of a domain towards its suffix, that of a host towards its domain: the posterior mean of each level is the
mean of the beta prior of the next, whose strength (in pages) is estimated from how far the children's rates spread around
their parent's beyond binomial noise. A url is blocked if even the upper bound of its host's posterior good rate is below
``LEAST_GOOD``; hosts without labelled pages get their domain's, suffix's or the corpus's rate, with the wide bound that
belongs to it.

Everything is counted by aggregation with partial sums; a host with a third of all pages is one row after it. The tables of
hosts that come back to the pages are left to adaptive execution, which splits hot hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.session import materialize

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_GOOD = 0.5
WIDTH = 1.645           # standard deviations from the mean to the bound: 95 % one-sided
STRENGTH = (2.0, 200.0)  # bounds of the estimated prior strength
#: Suffixes of two labels under which names are registered; every other suffix is the last label.
DOUBLE_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")


@dataclass(frozen=True)
class Rule:
    """Allow or block the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where names are registered below two."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES) & (host != two), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one more label; the host itself where there is none."""
    return F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; of equally long ones the first listed."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # longer ones wrap shorter ones
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _shrunk(children: DataFrame, parents: DataFrame, key: str, prior: str) -> DataFrame:
    """Posterior (``a``, ``b``) of each child, with the ``mean`` of its parent as the prior's.

    Strength by the method of moments: for k good of n pages at a prior mean m, E[(k/n - m)^2] = m(1-m) * (1/n + (1 - 1/n) /
    (s + 1)), summed over children with weights n.
    """
    rows = children.join(parents.select(F.col(prior), F.col("mean").alias("m")), prior)
    noise = F.col("m") * (1 - F.col("m"))
    totals = rows.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) - noise).alias("extra"),
        F.sum((F.col("n") - 1) * noise).alias("base"))
    low, high = STRENGTH
    strength = totals.select(F.when(
        (F.coalesce("extra", F.lit(0.0)) > 0) & (F.col("base") > 0),
        F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.col("base"), F.col("extra")) - 1)))
        .otherwise(high).alias("strength"))
    s = F.lit(strength.first()["strength"])  # one number
    a, b = F.col("m") * s + F.col("k"), (1 - F.col("m")) * s + F.col("n") - F.col("k")
    return rows.select(*children.columns, a.alias("a"), b.alias("b")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, k, mean and upper (bound) for every host of ``pages`` (page_id, host).

    ``outcomes`` has (page_id, good) for labelled pages. Without any outcome every mean is 0.5.
    """
    labelled = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    seen = pages.join(labelled, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = materialize(seen.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
                                    "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    corpus = suffixes.groupBy("all").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("mean"))
    suffixes = materialize(_shrunk(suffixes, corpus, "suffix", "all"), "suffixes")
    domains = materialize(_shrunk(domains, suffixes, "domain", "suffix"), "domains")
    hosts = _shrunk(hosts.drop("suffix"), domains, "host", "domain")
    a, b = F.col("a"), F.col("b")
    spread = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") + WIDTH * spread).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mean and upper of every page.

    A url that is null or has no ``://`` has an empty host and path, and the reputation of the empty host. Repeated rows are
    kept, and count as often as they stand there; rows without ``page_id`` have no outcomes. Other columns are ignored.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = reputations(own.select("page_id", "host"), outcomes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("upper") < LEAST_GOOD, "block").otherwise("allow")
    return own.join(hosts, "host").select("page_id", "url", "host", "path", rule.alias("rule"),
                                          F.coalesce(verdict, by_host).alias("verdict"), "mean", "upper")


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes for pages whose path names the document they were made from: ``/<language>/<doc_id>``."""
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    own = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id")).filter("doc_id is not null")
    return own.join(labels.select("doc_id", "quality"), "doc_id").select("page_id", (F.col("quality") == 1).alias("good"))
