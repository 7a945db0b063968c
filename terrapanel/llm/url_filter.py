"""URL filter: rules for hosts and paths, and link-graph propagation for the hosts that no rule decides.

Hosts most of whose pages a rule allows are trusted seeds, hosts most of whose
pages a rule blocks are blocked seeds. Trust spreads along links between hosts
(personalised PageRank from the trusted seeds); distrust spreads against them,
from blocked hosts to those that link to them. A host with enough distrust, and
more of it than trust, is blocked. Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import store, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s{0,8}=\s{0,8}["']?\s{0,8}(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """`allow` or `block` a host with its subdomains, for paths that start with the rule's."""

    verdict: str
    text: str  # host and path, as in example.com/en/

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, with A-Z in lower case; empty where there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, of equally long ones the first; NULL where none does.

    The rules are part of the expression: meant for some hundreds at most.
    """
    order = sorted(rules, key=lambda r: -len(r.text))
    fits = [F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<text: string, verdict: string>")


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """src, dst, n: links between different hosts; relative links stay within theirs."""
    links = F.regexp_extract_all(text_or_empty(f"`{html_col}`"), F.lit(LINK), F.lit(1))
    out = pages.select(host.alias("src"), F.explode(links).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return out.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """host, trust, distrust from `seeds` (host, kind "trust" or "distrust", mass).

    Each round passes `damping` of the last round's mass on, by the share of
    links: along them for trust, against them for distrust. Rounds stop when no
    host's score of either kind can still grow by more than `tolerance`, however
    many seeds there are; damping makes their number grow with the logarithm of
    the mass. What reaches a host that has no further link ends there.
    """
    out_n = edges.groupBy("src").agg(F.sum("n").alias("all"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    steps = store(
        edges.join(out_n, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("p"))
        .unionByName(edges.join(in_n, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("p"))))
    wave = store(seeds.select(F.col("host").alias("at"), "kind", "mass"))
    waves = [wave]
    # all that a kind's last wave can still add to one host's score is damping times the wave's mass
    while damping * max((r["mass"] for r in waves[-1].groupBy("kind").agg(F.sum("mass").alias("mass")).collect()), default=0.0) > tolerance:
        moved = waves[-1].join(steps, ["kind", "at"]).groupBy("to", "kind").agg((F.lit(damping) * F.sum(F.col("mass") * F.col("p"))).alias("mass"))
        waves.append(store(moved.select(F.col("to").alias("at"), "kind", "mass")))
    every = waves[0]
    for w in waves[1:]:
        every = every.unionByName(w)
    mass = lambda kind: ((1 - damping) * F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))).alias(kind)
    return every.groupBy(F.col("at").alias("host")).agg(mass("trust"), mass("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          damping: float = 0.85, tolerance: float = 1e-4, least_distrust: float = 0.01) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Else the host decides: it is blocked when
    its distrust is at least `least_distrust` and above its trust, where a seed
    has a mass of one; hosts that nothing reaches, pages without a host and
    NULL urls are allowed. Repeated pages each have their row. Other columns
    are not read.
    """
    url = F.col(f"`{url_col}`").cast("string")
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = own.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.sum((F.col("rule.verdict") == verdict).cast("int")) / F.count(F.lit(1)) > 0.5
    hosts = ruled.filter("host <> ''").groupBy("host").agg(F.coalesce(share("allow"), F.lit(False)).alias("good"), F.coalesce(share("block"), F.lit(False)).alias("bad"))
    seeds = hosts.filter("good OR bad").select("host", F.when(F.col("good"), "trust").otherwise("distrust").alias("kind"), F.lit(1.0).alias("mass"))
    edges = store(host_edges(pages, host_of(url), html_col))
    scores = propagate(edges, seeds, damping, tolerance)
    out = ruled.join(scores, "host", "left")
    bad = (F.col("distrust") >= least_distrust) & (F.col("distrust") > F.col("trust"))
    by_host = F.when(bad, "block").otherwise("allow")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("rule.text").alias("rule"), F.coalesce(F.col("rule.verdict"), by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
