"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges are stars: O(log^2 n) rounds, each one
    aggregate and one join, so no node's neighbours are ever gathered. Every round is a table in the shared folder.
    Edges with a null end, and loops, are ignored; direction and repetition of edges do not matter. No edges: no rows.
    """
    known = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("void"))
    stars = saved(known.where("not void and u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        stars = saved(_small_star(_large_star(stars)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour larger than a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
