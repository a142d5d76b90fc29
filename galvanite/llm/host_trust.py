"""URL filter: rules first, then trust and distrust propagated over the host graph.

Edges are the absolute links of a page's html to other hosts, and from each
host to its parent domain and back. Trust is a personalised PageRank from the
hosts with allowed pages along the edges, distrust one from the hosts with
blocked pages against them. Both run as one Spark job per round, until the
ranks of all hosts have settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.llm.shared import ascii_lower, staged

# Fixed values: (verdict, host, path) of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, and each host with its parent domain.

    Only the needed part of a link (its host) leaves the page's row; equal
    edges are counted before the shuffle.
    """
    link = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\shref\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\s\"'<>/?#]+)"), F.lit(1))))
    links = pages.select(host_of(F.col("url")).alias("src"), link.alias("to")).select("src", host_of(F.col("to")).alias("dst"))
    links = links.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.select(host_of(F.col("url")).alias("src")).where("src != ''").unionByName(links.select(F.col("dst").alias("src"))).distinct()
    up = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst != ''").withColumn("n", F.lit(1.0))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, check_every: int = 5) -> DataFrame:
    """side, host, rank of a personalised PageRank per side.

    `edges`: side, src, dst, n; `seeds`: side, host, share (sums to 1 per
    side). Rounds go on until the summed change is at most `tolerance` times
    the rank mass; the change shrinks by `damping` per round, so this ends.
    Rank that reaches a host without edges leaves the walk.
    """
    out = edges.groupBy("side", "src").agg(F.sum("n").alias("total"))
    walk = staged(edges.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total") * damping).alias("w")), "walk")
    start = staged(seeds.select("side", "host", (F.col("share") * (1 - damping)).alias("rank")), "seeds")
    ranks, before = start, None
    while True:
        for _ in range(check_every):
            moved = walk.join(ranks.withColumnRenamed("host", "src"), ["side", "src"]).select("side", F.col("dst").alias("host"), (F.col("w") * F.col("rank")).alias("rank"))
            ranks = moved.unionByName(start).groupBy("side", "host").agg(F.sum("rank").alias("rank"))
        ranks = staged(ranks, "ranks")
        mass = ranks.agg(F.sum("rank")).first()[0] or 0.0
        # Ranks only grow from the seeds on, so the growth of the mass is the whole change.
        if before is not None and mass - before <= tolerance * mass:
            return ranks
        before = mass


def judge_urls(pages: DataFrame, rules=RULES, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row of `pages` (page_id, url, html).

    Without a rule a host is blocked if its distrust exceeds `ratio` times its
    trust; hosts that neither reaches are allowed. Null urls have an empty
    host and path and are allowed; repeated rows repeat; ties are allowed.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_columns(host, path, rules)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("fixed"))
    edges = staged(host_edges(pages), "edges")
    forward = edges.select(F.lit("trust").alias("side"), "src", "dst", "n")
    backward = edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    seeds = ruled.where("fixed IS NOT NULL AND host != ''").groupBy("host", "fixed").agg(F.count("*").alias("n"))
    seeds = seeds.select(F.when(F.col("fixed") == "allow", "trust").otherwise("distrust").alias("side"), "host", "n")
    seeds = seeds.join(seeds.groupBy("side").agg(F.sum("n").alias("total")), "side").select("side", "host", (F.col("n") / F.col("total")).alias("share"))
    ranks = propagate(forward.unionByName(backward), seeds)
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("rank"))), F.lit(0.0)).alias(side)
    per_host = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    judged = ruled.join(per_host, "host", "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "trust", "distrust")
