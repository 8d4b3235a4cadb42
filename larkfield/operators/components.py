"""Connected components of an undirected graph, as rounds of joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larkfield.runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; root is the smallest node reachable.

    Alternates the large-star and small-star rewrites until the edge set is a forest of stars, which
    takes about log(diameter) rounds. Every round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Nulls and self loops are ignored; repeated
    edges count once; an empty table gives no rows.
    """
    x, y = F.col(a), F.col(b)
    now = scratch.save(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct(),
        "edges",
    )
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join with it is one that Spark splits where a node is a hub
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (
            both.where("v > u").join(low, "u").where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u != v").distinct()
        )
        new = scratch.save(small, "edges")
        scratch.drop(now)
        scratch.drop(low)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of one edge to a node that leads nowhere: then each star is a component."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("r"))
    by_node = roles.groupBy("r.x").agg(F.sum("r.out").alias("out"), F.min("r.out").alias("least"))
    return not by_node.where("out > 1 OR (out = 1 AND least = 0)").limit(1).count()
