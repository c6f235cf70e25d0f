"""URL verdicts by rules and, where no rule fits, by trust and distrust spread over the graph of hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are distrusted
ones, weighted by the share of their pages. Personalised PageRank carries trust along links and
distrust against them; links are counted per pair of hosts before anything is joined, and hosts
that are only linked to are nodes too. Links are absolute, without a scheme, or relative to a base of
another host. With `kin` above 0 a host is also linked, by that weight, each way with the host that
its own name lies under: such edges are no links, but sites that share a name share an owner. A host
is blocked whose distrust exceeds its trust by more than a threshold, in units of an even share over
all hosts.

Defined cases: a null URL or one without :// has an empty host and path and fits no rule; a null page
has no links; a host without seeds and links around it is allowed; pages with equal ids are judged
one by one, repeated rows count as pages; an empty table gives no rows; pages of any length are
searched whole, for links only; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a host's score that it passes on, rounds between two writes, and the share of the threshold that a score may be off.
DAMPING, AT_ONCE, ENOUGH = 0.85, 4, 1e-2
#: Weight of an edge between a host and the one its name lies under, in links; 0 for no such edges.
KIN = 1.0
#: Links in a page, those that name a host, and the base of the others.
HREF = r"""(?i)<(?!base\b|link\b)[a-z][^>]*?\shref\s*+=\s*+["']?\s*+([^"'\s>]++)"""
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*+:)?//"
BASE = r"""(?i)<base\b[^>]*?\shref\s*+=\s*+["']?\s*+([^"'\s>]++)"""
#: Distrust over trust, in even shares, beyond which a host is blocked.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, the longest rule that fits and its verdict, both null without one."""
    host, path = host_and_path(F.col("url").cast("string"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # a longer rule is asked first
        fits = r.fits(F.col("host"), F.col("path"))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return p.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def linked_hosts(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    html = F.col("html").cast("string")
    host, _ = host_and_path(F.col("url").cast("string"))
    base, _ = host_and_path(_with_scheme(F.regexp_extract(html, BASE, 1)))
    p = pages.select(host.alias("src"), base.alias("base"), F.regexp_extract_all(html, F.lit(HREF), F.lit(1)).alias("links")).where("src <> '' and links is not null")
    p = p.select("src", "base", F.explode("links").alias("link"))
    absolute = F.col("link").rlike(ABSOLUTE)
    to, _ = host_and_path(_with_scheme(F.col("link")))
    # what is neither absolute nor of another scheme is relative to the base
    p = p.select("src", F.when(absolute, to).when(~F.col("link").rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.\-]*+:)"), F.col("base")).alias("dst"))
    return p.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(url)


def kin_of(hosts: DataFrame) -> DataFrame:
    """(src, dst): a host and the one its name lies under, if that is a host here, each way."""
    up = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1, length(host))").alias("dst")).where("instr(src, '.') > 0")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    return up.union(up.select("dst", "src"))


def host_graph(pages: DataFrame, hosts: DataFrame, kin: float = KIN) -> tuple[DataFrame, DataFrame]:
    """All hosts (host, allowed, blocked) and edges between them (src, dst, n)."""
    links = written(linked_hosts(pages))
    ends = links.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti")
    nodes = written(hosts.select("host", "allowed", "blocked").union(ends.select("host", F.lit(0.0), F.lit(0.0))))
    edges = links.select("src", "dst", F.col("n").cast("double").alias("n"))
    if kin > 0:
        edges = edges.union(kin_of(nodes).withColumn("n", F.lit(float(kin)))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return nodes, edges


def propagated(hosts: DataFrame, links: DataFrame, *, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust), each adding up to the number of hosts if it has any seed; runs until no score is off by
    more than a small share of the threshold, or for so many rounds."""
    seeds = hosts.select("host", F.expr("inline(array(struct('trust' as kind, allowed as seed), struct('distrust' as kind, blocked as seed)))"))
    sums = seeds.groupBy("kind").agg(F.sum("seed").alias("whole"))
    seeds = written(seeds.join(F.broadcast(sums), "kind").select("kind", "host", F.when(F.col("whole") > 0, F.col("seed") / F.col("whole")).otherwise(0.0).alias("seed")))
    both = links.select("src", "dst", "n", F.lit("trust").alias("kind")).union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    ranks = seeds.withColumn("rank", F.col("seed"))
    if not edges.isEmpty():
        # an even share is 1 / hosts of a whole of 1 - damping at least; what is still to come is about as much as the last change
        enough = ENOUGH * abs(threshold) * (1 - damping) / max(hosts.count(), 1)
        for _ in itertools.count() if rounds is None else range(0, rounds, AT_ONCE):
            before = ranks
            for _ in range(AT_ONCE):
                given = edges.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("given"))
                ranks = seeds.join(given, ["kind", "host"], "left").select("kind", "host", "seed", ((1 - damping) * F.col("seed") + F.coalesce("given", F.lit(0.0))).alias("rank"))
            ranks = written(ranks)
            change = ranks.join(before.select("kind", "host", F.col("rank").alias("old")), ["kind", "host"]).agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if not change or change < max(enough, 1e-14):
                break
    total = ranks.groupBy("kind").agg(F.sum("rank").alias("whole"), F.count(F.lit(1)).alias("hosts"))
    scaled = ranks.join(F.broadcast(total), "kind").withColumn("rank", F.when(F.col("whole") > 0, F.col("rank") / F.col("whole") * F.col("hosts")).otherwise(0.0))
    return scaled.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.max(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def judged(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, kin: float = KIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    p = written(ruled(pages, rules))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = written(p.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    scores = propagated(*host_graph(pages, hosts, kin), threshold=threshold)
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return p.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
