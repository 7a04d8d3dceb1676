"""URL rules, and host verdicts by propagating trust and distrust over the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.shared import ascii_lower, materialize, release

#: (verdict, host, path)
Rule = tuple[str, str, str]
DAMPING = 0.85
#: Propagation goes on until no host's rank changes by more than this share of itself; ranks closer than ``TIE`` count as equal.
TOLERANCE, TIE = 1e-6, 1e-5
#: What isn't markup of the page: comments, scripts and styles, to the end of the page if they are not closed.
ASIDE = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"""
#: A link of a tag to a host, with a scheme or relative to the page's, up to the end of the host.
HREF = r"""(?i)<[a-z][^<>]*?\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's; else null."""
    tests = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        )
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host; links within a host say nothing about trust, nor do those in comments or scripts."""
    markup = F.regexp_replace(html_col, ASIDE, " ")
    links = pages.select(url_host(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(markup, F.lit(HREF), 1)).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): two personalised PageRanks, iterated until no rank changes by more than ``tolerance`` of itself.

    edges: (src, dst, n). Trust starts at hosts with ``trusted`` > 0 and follows links; distrust starts at hosts with ``blocked`` > 0 and
    follows links backwards: who links to the blocked is suspect. seeds: (host, trusted, blocked), weights of one host each. Ranks are in the
    units of these weights, whatever their sum, so that what a neighbourhood gets does not depend on how much else there is. They are damped at
    each step, and what a host without links holds is not passed on. A host first reached changes by all of its rank, so the loop
    ends only when every host that seeds reach has been. Every step joins a rank a host with an edge a pair of hosts and is summed before it is shuffled.
    """
    arcs = edges.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    arcs = arcs.unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = arcs.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    arcs = materialize(arcs.join(out, ["kind", "a"]).select("kind", "a", "b", (F.lit(damping) * F.col("n") / F.col("all")).alias("w")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("trusted"), F.lit("d"), F.col("blocked"))).alias("kind", "x")).filter("x > 0")
    start = materialize(start.select("kind", "host", (F.lit(1 - damping) * F.col("x")).alias("x")))
    rank, none = start, F.lit(0.0).alias("was")
    moving = bool(arcs.head(1))
    while moving:
        given = rank.join(arcs, (rank.kind == arcs.kind) & (rank.host == arcs.a)).select(arcs.kind, F.col("b").alias("host"), (F.col("x") * F.col("w")).alias("x"), none)
        before = rank.select("kind", "host", F.lit(0.0).alias("x"), F.col("x").alias("was"))
        after = materialize(given.unionByName(start.select("kind", "host", "x", none)).unionByName(before).groupBy("kind", "host").agg(F.sum("x").alias("x"), F.sum("was").alias("was")))
        moving = bool(after.filter(F.abs(F.col("x") - F.col("was")) > tolerance * F.col("x")).head(1))
        if rank is not start:
            release(rank)
        rank = after
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("x"))), F.lit(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], margin: float = TIE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    A url takes the verdict of the longest rule that fits it. Any other url takes its host's: block if distrust exceeds trust by more than the share
    ``margin`` of it, else allow, so hosts that no seed reaches are allowed. Seeds are the hosts of pages that a rule allows or blocks, weighted by the number of
    those pages. Null urls and urls without :// have an empty host and path, which is neither a seed nor linked. Null html has no links.
    Repeated rows are judged each, and count each. Other columns are not read. No rows give no rows.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    seen = seen.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", "found.rule", F.col("found.verdict").alias("given"))
    seeds = seen.filter("host <> '' AND given IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("given") == "allow").cast("double").alias("trusted"), F.count_if(F.col("given") == "block").cast("double").alias("blocked")
    )
    ranks = materialize(propagate(materialize(host_edges(pages, url_col, html_col)), materialize(seeds), damping))
    both = seen.join(ranks, "host", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") > F.col("trust") * (1 + margin), "block").otherwise("allow")
    return both.select(id_col, "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "trust", "distrust")
