"""Connected components by alternating stars, for graphs of any size.

Each round replaces the edges by stars around ever smaller ids (large star, then small star); a logarithmic number of
rounds ends with every node linked straight to the least id of its component. A round aggregates before it shuffles
(the least neighbour per node) and joins that back, so a hub with very many neighbours is one small row on one side and
splittable rows on the other; no group is ever gathered. Rounds are cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = _least_neighbour(both).select("a", F.least("a", "m").alias("m"))
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    least = _least_neighbour(down)
    moved = down.join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("a").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long) that is not its component's least id; no edges, no rows.

    Self-loops and repeated or reversed edges change nothing; rows with a null end are ignored.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u != v").distinct())
    seen = state(edges)
    while seen[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
