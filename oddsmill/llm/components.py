"""Connected components by alternating large-star and small-star rounds, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.session import durable


def _star(edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` after one large-star and one small-star round.

    Minima are combined before the shuffle. In the joins the side of minima has one row a node, so the other side of a
    hot node can be split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Loops, repeated edges and edges with a null end are ignored (a node that has only such edges is not returned). Every
    round is written to shared storage, which cuts the lineage; the rounds end when the edges no longer change."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    cur, seen = durable(ends.distinct()), None
    for _ in range(max_rounds):
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, cur = mark, durable(_star(cur))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
