"""Connected components of a distributed link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwave.llm.base import checkpointed, join_groups

#: Links of one node from which on nodes of many links are joined by a broadcast.
HUB = 20_000


def with_least(links: DataFrame, crowded: bool) -> DataFrame:
    """Links (a, b) with m, the least b of each a."""
    if not crowded:
        return links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_groups(links, checkpointed(least), ["a"])


def large_star(edges: DataFrame, crowded: bool) -> DataFrame:
    """Every node links its larger neighbours to the least node around it; links may come several times."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return with_least(both, crowded).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def small_star(edges: DataFrame, crowded: bool) -> DataFrame:
    """Every node links itself and its smaller neighbours, a > b, to the least of them."""
    moved = with_least(edges, crowded).select(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))).alias("two"))
    return moved.select(F.inline("two")).where("a <> b").distinct()


def shape(edges: DataFrame) -> tuple[int, bool]:
    """The most links of a node, and whether links, a > b, are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    most, other = nodes.agg(F.max("n"), F.max((F.col("up") > 0) & (F.col("n") > 1))).first()
    return most or 0, not other


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (a, b); component is the smallest node reachable.

    Nodes without a link have no row. Each round cuts its lineage by a checkpoint in the shared folder; rounds grow
    with the logarithm of the longest chain and end when all links are stars. Self links and repeated links are
    harmless. More than HUB links of a node never meet in one task: then the least nodes of the heaviest are broadcast.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    most, done = shape(now)
    while not done:
        crowded = most > HUB
        outward = large_star(now, crowded)
        now = checkpointed(small_star(checkpointed(outward) if crowded else outward, crowded))
        most, done = shape(now)
    return now.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))).distinct()
