"""Connected components of an edge list by alternating large-star and small-star rounds.

Each round rewires every node to the smallest neighbour it can see, until the edges are stars
around the smallest node of each component.  A round is two aggregates and a join per star, so it
needs no node's neighbours in one place; its result is written before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled


def _least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least of u and all its neighbours as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _least(down)
    star = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.unionByName(seen.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long): each node that isn't the least of its component, with the least.

    Columns: node, root.  Loops and repeated edges don't matter; no edges give no rows.
    """
    now = settled(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = settled(_small_star(_large_star(now)).where("u <> v").distinct(), "star")
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))
        ).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
