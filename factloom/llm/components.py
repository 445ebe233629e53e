"""Connected components by alternating large-star and small-star steps, each a pair of grouped joins.

No vertex's neighbours are ever gathered, nothing but two numbers per round reach the driver, and each
round's edges are a table in the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    links = spread_join(both.filter("v > u"), m, ["u"], n)
    return links.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges here go from the larger end u to the smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    links = spread_join(down, m, ["u"], n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return links.filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """(u, root): every vertex of `edges` (u, v) that isn't the least of its component, with that least.

    Duplicate edges, loops and either direction are fine; an empty table gives an empty result. A hub's edges are
    joined by broadcast of the hub's least neighbour. Each round at least halves the length of the longest path to a root,
    about: if the edges still change after `rounds`, that is an error, and no half result is returned.
    """
    now = scratch.put(edges.select("u", "v").filter("u != v").distinct(), "edges")
    mark: tuple = (now.count(), None)
    for _ in range(rounds):
        now = scratch.put(_small_star(_large_star(now, 2 * mark[0]), mark[0]), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components not done after {rounds} rounds")
