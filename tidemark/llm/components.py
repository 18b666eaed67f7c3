"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Stage


def components(links: DataFrame, stage: Stage, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links(u, v); root is the smallest node that it reaches.

    Alternates large-star and small-star steps: each node hands its larger (smaller) neighbours to its smallest
    one, until only stars around the roots are left. Minima are pre-aggregated; they are written out before the
    join, so that the join may split the links of a hub over tasks.
    """
    edges = stage.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stage.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = stage.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        kept = large.join(least2, "u").select("u", "v", "m")
        small = stage.table(kept.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "small")
        stage.drop(edges, least, large, least2)
        edges = small
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    # Every node is in a star now: leaves point to the root, the root to itself.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
