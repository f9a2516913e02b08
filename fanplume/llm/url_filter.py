"""Filter pages by rules for their addresses, and by what the links between hosts say of those that no rule fits."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanplume.llm.common import discard, stored, without

#: Rules that become one conditional expression; more are an error.
MOST_RULES = 1000
#: Masses are whole numbers, so many to a page: sums don't depend on the order of their parts.
UNIT = 1_000_000
#: The host of each link to another host, in a tag that ends before the next one begins.
LINK = r"(?i)<a[\x20\x09-\x0D][^<>]*?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*(?:[\"'][\x20\x09-\x0D]*)?(?:https?:)?//([^/?#\"'<>\x20\x09-\x0D]+)"
#: Rounds of propagation between two stored tables.
CHAIN = 5


@dataclass(frozen=True)
class Rule:
    """Pages of a host and its subdomains whose path begins with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def lowered(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return lowered(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def told(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """`pages` with __host, __path, __rule and __said (the verdict of the longest rule that fits; null if none does)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    host, path = address(F.col("__url"))
    out = pages.withColumn("__url", F.col(f"`{url_col}`")).withColumns({"__host": F.coalesce(host, F.lit("")), "__path": F.coalesce(path, F.lit(""))})
    rule = said = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one set comes first
        fits = r.fits(F.col("__host"), F.col("__path"))
        rule, said = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(said)
    return out.withColumns({"__rule": rule, "__said": said}).drop("__url")


def host_edges(pages: DataFrame, html_col: str, kin: int) -> DataFrame:
    """Links between different hosts (src, dst, weight): how many links of pages there are, and `kin` between a host
    and the domain that it is a part of, both ways, down to two labels."""
    links = pages.filter("__host <> ''").select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all(f"`{html_col}`", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lowered(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    if not kin:
        return links.filter("src <> dst")
    # A host's chain is its own name and the domains above it, so it grows with the name alone.
    hosts = pages.filter("__host <> ''").select(F.col("__host").alias("host")).distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    named = hosts.withColumn("labels", labels).filter((F.size("labels") > 2) & ~F.col("host").rlike(r"\A[0-9.:]*\z")).withColumn("chain", chain)
    steps = named.select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("b"))).alias("step")).select("step.a", "step.b").distinct()
    weight = F.lit(kin).cast("long").alias("weight")
    every = links.unionByName(steps.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight)).unionByName(steps.select(F.col("b").alias("src"), F.col("a").alias("dst"), weight))
    return every.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Personalised PageRank of both sides at once: trust along links, distrust against them.

    `seeds` (side, host, mass) are where walks begin again, `edges` (src, dst, weight) carry `damping` of what a host
    has to its neighbours by weight, in whole numbers; what a host without neighbours would send is lost. Each round is
    a join by host, which adaptive execution splits at hosts with many links, and a sum with partial aggregates.
    Returns side, host, mass.
    """
    both = edges.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("side", "src").agg(F.sum("weight").alias("every"))
    shares = stored(both.join(out, ["side", "src"]).select("side", "src", "dst", (F.lit(damping) * F.col("weight") / F.col("every")).alias("share")))
    start = stored(seeds)
    again = start.select("side", "host", F.floor(F.lit(1 - damping) * F.col("mass")).alias("mass"))
    mass, held = start, None
    for k in range(1, rounds + 1):
        moved = shares.join(mass.withColumnRenamed("host", "src"), ["side", "src"]).select("side", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share")).alias("mass"))
        mass = again.unionByName(moved).groupBy("side", "host").agg(F.sum("mass").alias("mass"))
        if k % CHAIN == 0 or k == rounds:
            last, mass = held, stored(mass)
            discard(last)
            held = mass
    discard(shares)
    return mass


def judge_urls(pages: DataFrame, rules: list[Rule], damping: float = 0.85, rounds: int = 20, margin: float = 2.0, kin: int = 1, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Allow or block each page: as the longest rule says that fits it, else as its host deserves.

    Pages that a rule allows are trust at their host, those it blocks are distrust; `propagate` carries both over the
    links between hosts. A host is blocked if its distrust is more than `margin` times its trust; hosts that neither
    reaches are allowed. Hosts are judged by all pages; rows that repeat count each time.

    Returns the columns of `pages` plus host, path, rule (host and path of the rule, or null), verdict, trust and
    distrust (of the host, in millionths of a page); columns of those names are replaced. Null addresses and those
    without `://` have an empty host and path, no rule, and are allowed; null html has no links. An empty table gives
    an empty one. Texts are searched in time that grows with their length.
    """
    base = told(without(pages, ["host", "path", "rule", "verdict", "trust", "distrust"]), rules, url_col)
    seeds = base.filter("__said IS NOT NULL").groupBy(F.when(F.col("__said") == "allow", "trust").otherwise("distrust").alias("side"), F.col("__host").alias("host"))
    found = propagate(seeds.agg((F.count(F.lit(1)) * UNIT).alias("mass")), host_edges(base, html_col, kin), damping, rounds)
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("mass"))), F.lit(0)).alias(f"__{name}")
    hosts = found.groupBy(F.col("host").alias("__host")).agg(side("trust"), side("distrust"))
    out = base.join(hosts, "__host", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in ("__trust", "__distrust")})
    own = F.when(F.col("__distrust") > F.lit(margin) * F.col("__trust"), "block").otherwise("allow")
    kept = [F.col(f"`{c}`") for c in base.columns if c not in ("__host", "__path", "__rule", "__said")]
    return out.select(
        *kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__said", own).alias("verdict"), F.col("__trust").alias("trust"), F.col("__distrust").alias("distrust")
    )
