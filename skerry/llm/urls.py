"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk level by level: all pages -> suffix -> registered domain -> host.
At each level the prior strength is the beta-binomial moment estimate of how much groups of that level differ; a group's
posterior mean is the prior mean of the groups below it. A host is blocked where the lower bound of its posterior share
of bad pages passes the threshold, so a host with few labels follows its domain, and a domain with few its suffix.

Everything is built-in expressions. Pages meet host counts in a partial aggregate, so a host with a third of all pages
is one row per task; its verdict goes back to pages over a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.mx", "com.ar", "com.tr", "co.in", "co.za", "com.cn")


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
THRESHOLD = 0.5
Z = 1.645


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


class Suffixes:
    """The names under which domains are registered, by rules as public suffix lists have them: ``co.uk``, ``*.ck`` (any one
    label before), ``!www.ck`` (an exception). The longest rule decides, and any last label is a suffix."""

    def __init__(self, rules: Iterable[str] = TWO_LABEL_SUFFIXES):
        self.plain: dict[int, list[str]] = {}
        self.wild: dict[int, list[str]] = {}
        self.not_: dict[int, list[str]] = {}
        for rule in rules:
            kind, name = (self.not_, rule[1:]) if rule.startswith("!") else (self.wild, rule[2:]) if rule.startswith("*.") else (self.plain, rule)
            kind.setdefault(name.count(".") + 1 + (kind is self.wild), []).append(name)

    @classmethod
    def read(cls, file: str) -> Suffixes:
        """Rules from a file on the driver in the lists' usual format: one a line, comments after ``//``."""
        with open(file, encoding="utf-8") as f:
            rules = [line.split()[0] for line in f if line.strip() and not line.startswith("//")]
        return cls(rules)

    def _labels(self, host: Column) -> Column:
        """How many labels of the host are its suffix."""
        dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
        count = F.lit(1)
        for n in sorted({*self.plain, *self.wild} - {1}):
            fits = F.substring_index(host, ".", -n).isin(self.plain.get(n, []))
            if n in self.wild:
                fits = fits | ((dots >= n - 1) & F.substring_index(host, ".", 1 - n).isin(self.wild[n]))
            count = F.when(fits, F.lit(n)).otherwise(count)
        for n, names in sorted(self.not_.items()):
            count = F.when(F.substring_index(host, ".", -n).isin(names), F.lit(n - 1)).otherwise(count)
        return count

    def of(self, host: Column) -> tuple[Column, Column]:
        """The registered domain (the suffix and one label more) and the suffix of a host. A port is no part of either; an
        address of numbers is its own domain and has no suffix."""
        bare = F.regexp_replace(host, ":[0-9]*$", "")
        address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
        labels = self._labels(bare)
        tail = lambda n: F.call_function("substring_index", bare, F.lit("."), -n)
        return F.when(address, bare).otherwise(tail(labels + 1)), F.when(address, F.lit("")).otherwise(tail(labels))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame, least: float = 1.0, most: float = 10_000.0) -> DataFrame:
    """One row ``s``: the prior strength by moments of the shares b/n over groups with labels. Of (n, b) rows."""
    some = groups.filter("n > 0")
    sums = some.agg(
        F.sum("n").alias("nn"), F.sum("b").alias("bb"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("b2")
    )
    mean = F.col("bb") / F.col("nn")
    var = mean * (1 - mean)
    between = F.col("b2") - F.col("nn") * mean * mean  # sum of n (p - mean)^2
    scale = (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("k") - 1)) * var
    rho = (between - (F.col("k") - 1) * var) / scale
    good = (F.col("k") > 1) & (F.col("nn") > 0)
    inner = F.when(rho <= 0, F.lit(most)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), 1 / rho - 1)))
    return sums.select(F.when(good, F.when((var > 0) & (scale > 0), inner).otherwise(F.lit(most))).otherwise(F.lit(most)).alias("s"), F.when(F.col("nn") > 0, mean).otherwise(F.lit(0.0)).alias("mean"))


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = Z, suffixes: Suffixes | None = None) -> DataFrame:
    """(host, domain, suffix, n, b, mean, lower): per host of ``pages`` (page, host), its labels (page, bad) and posterior."""
    counted = pages.join(labels.groupBy("page").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("b")), "page", "left")
    hosts = counted.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("b"))
    domain, suffix = (suffixes or Suffixes()).of(F.col("host"))
    # every level starts from the hosts' counts: they are made once
    hosts = written(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "b"), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    s0, s1, s2 = _strength(suffixes), _strength(domains), _strength(hosts)
    post = lambda m: (F.col("b") + F.col("s") * m) / (F.col("n") + F.col("s"))
    suffix_mean = suffixes.crossJoin(F.broadcast(s0)).select("suffix", post(F.col("mean")).alias("m0"))  # s0 to s2 are one row each
    domain_mean = domains.join(suffix_mean, "suffix").crossJoin(F.broadcast(s1.select("s"))).select("domain", "suffix", post(F.col("m0")).alias("m1"))
    judged = hosts.join(domain_mean, ["domain", "suffix"]).crossJoin(F.broadcast(s2.select("s")))
    judged = judged.select("host", "domain", "suffix", "n", "b", post(F.col("m1")).alias("mean"), (F.col("n") + F.col("s")).alias("weight"))
    spread = F.sqrt(F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(0.0)) / (F.col("weight") + 1))
    return judged.withColumn("lower", F.col("mean") - z * spread)


def judge_urls(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD, z: float = Z, suffixes: Suffixes | None = None) -> DataFrame:
    """(page, host, path, rule, verdict, bad_lower_bound): every row of ``pages`` once, repeated ones as often as they come.

    ``labels`` has columns page and bad (boolean). A null url, or one without ``://``, has an empty host and path; the
    empty host has a reputation like any other. A null page cannot be labelled. Where nothing is labelled, nothing is
    bad. Other columns of either table are ignored. ``suffixes`` are the built-in ones unless others are given.
    """
    rows = pages.select(F.col(f"`{page}`").alias("page"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    known = host_reputation(rows.select("page", "host"), labels, z, suffixes).select("host", "lower")
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(F.col("page").alias(page), "host", "path", text.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.col("lower").alias("bad_lower_bound"))
