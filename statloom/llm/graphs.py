"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of its component.

    Alternates the large-star and small-star steps, which keep components and end, after few rounds, in stars
    around the smallest nodes.  Each step only takes minima per node, which collapse within the tasks, so a hub
    with very many edges does no harm; every step is cut from its lineage.  Edges that are stars already, as
    those of an earlier result, take no round at all.
    """
    work = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while not _stars(work):
        both = work.select(F.col("a").alias("u"), F.col("b").alias("v")).union(work.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # at most as many edges as before, repeated ones among them
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b"), tag)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        work = cut(small, tag)
    return work.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        work.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end `a` of the distinct edges has one edge only and is no smaller end `b`."""
    one = F.lit(1).cast("long")
    ends = edges.select(F.col("a").alias("n"), one.alias("up"), (one - 1).alias("down")).union(
        edges.select(F.col("b").alias("n"), (one - 1).alias("up"), one.alias("down")))
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0
