"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmark.llm._common import few, written


def _large(edges: DataFrame, count: int) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(few(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), count))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame, count: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to its smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(few(down.groupBy("u").agg(F.min("v").alias("low")), count))
    handed = down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return handed.unionByName(least.select("u", F.col("low").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of the component as root; nodes without edges are absent.

    edges: (u, v), a table that is read twice. Every round is two shuffled star operations; the
    edges shrink to one per node in a number of rounds that grows with the logarithm of the graph.
    Minima are written before they are joined, so that Spark can split the rows of a node with very
    many neighbours. It ends once the edges are stars around roots, which one count of them tells;
    by the count of the edges their tables are written in few files.
    """
    count = edges.count()
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(few(edges.distinct(), count))
    while not _are_stars(edges, count):
        edges = written(few(_small(_large(edges, count), count).where("u <> v").distinct(), count))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame, count: int) -> bool:
    """Whether every node has one edge down, or edges up only. edges: distinct, u > v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return few(sums, count).agg(F.max(F.expr("down > 1 OR (down > 0 AND up > 0)"))).first()[0] is not True
