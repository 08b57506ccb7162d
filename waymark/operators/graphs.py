"""Connected components by star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.shared import saved


#: Edges of a graph whose rounds are one job each; half rounds of a larger one are written too.
SMALL = 2_000_000


def min_label(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """node and label (the smallest node of its component); ``edges`` are (a, b), in either direction or both.

    Alternating large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the least node around it, until each
    component is a star around its least node.  Rounds grow with the logarithm
    of the graph; each is one pre-aggregated minimum and one join, is written,
    and only a count and a checksum come back.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most):
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if now[0] <= SMALL else saved(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = saved(others.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    stars = e.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return nodes.join(stars, nodes["node"] == stars["_a"], "left").select("node", F.coalesce("_b", "node").alias("label"))
