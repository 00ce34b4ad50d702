"""URL filtering by rules and by propagation over the link graph (DataFrame functions only).

Rules on (host, path) decide where one fits. For all other pages the host decides: trust flows
along links from hosts that rules allow (personalised PageRank), distrust flows against the
links from hosts that rules block (a host that links to blocked hosts is suspect). A host is
blocked when its distrust exceeds its trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmark.checkpoints import checkpoint_folder

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Comments and scripts, and a link in what follows a `<`.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1|\z)"
_LINK = r"""(?is)^a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) of links between different hosts in the pages' html.

    Links without a scheme (//host/...) count, links in comments and scripts do not. The html is cut
    at each `<` first, so that every part is searched once, whatever is left unclosed.
    """
    shown = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), _HIDDEN, " ")
    tags = F.filter(F.split(shown, "<"), lambda tag: F.lower(F.substring(tag, 1, 1)) == "a")
    links = F.filter(F.transform(tags, lambda tag: F.regexp_extract(tag, _LINK, 1)), lambda link: link != "")
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    found = found.withColumn("link", F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    edges = found.select("src", host_of(F.col("link")).alias("dst"))
    return edges.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def personal_rank(edges: DataFrame, seeds: DataFrame, steps: int = 8, damping: float = 0.85) -> DataFrame:
    """(host, rank): PageRank that restarts at the seeds. edges: src, dst, links; seeds: host, mass.

    Mass that reaches a host without outgoing links ends there. Ranks are cut from their lineage
    every other step; each step shuffles one row per host and one per edge.
    """
    checkpoint_folder(edges.sparkSession)
    total = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    shares = edges.join(total, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("share"))
    if shares.isEmpty():
        return seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    shares = shares.checkpoint()
    restart = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    ranks = restart
    for step in range(steps):
        sent = (
            ranks.join(shares, ranks["host"] == shares["src"])
            .select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        )
        ranks = restart.unionByName(sent).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % 2:
            ranks = ranks.checkpoint()
    return ranks


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, steps: int = 8, margin: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed.
    Pages of a host without any propagated distrust are allowed. Null html has no links.
    Repeated pages are judged each. Empty table: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    checkpoint_folder(spark)
    url = F.col("url").cast("string")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    hosts = (
        judged.where("host <> ''")
        .groupBy("host")
        .agg(
            F.avg(F.when(F.col("found.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
            F.avg(F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        )
        .checkpoint()
    )
    edges = host_edges(pages.select("url", F.col("html").cast("string"))).checkpoint()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = personal_rank(edges, hosts.where("allowed > 0").select("host", F.col("allowed").alias("mass")), steps)
    distrust = personal_rank(back, hosts.where("blocked > 0").select("host", F.col("blocked").alias("mass")), steps)
    scores = (
        trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        .checkpoint()
    )
    trust_of, distrust_of = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust_of > trust_of + margin, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_host).alias("verdict"),
        trust_of.alias("trust"),
        distrust_of.alias("distrust"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
