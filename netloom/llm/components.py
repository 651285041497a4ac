"""Connected components by alternating large-star and small-star rounds.

Every round is joins and aggregates on the edge table, written to the shared folder; the number of rounds
grows with the logarithm of the longest chain.  No vertex's neighbours are gathered: a minimum per vertex is
a partial aggregate, and joins on a hot vertex are left to the skew handling of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a vertex to the smallest of the vertex and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def star_roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every vertex that is not the smallest of its component.

    ``edges`` has columns u and v of one orderable type; loops, repeats and either direction are fine.
    """
    def state(e):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
              "edges")
    last = state(now)
    for _ in range(most_rounds):
        if not last[0]:
            break
        now = cut(_small_star(_large_star(now)), "edges")
        seen = state(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
