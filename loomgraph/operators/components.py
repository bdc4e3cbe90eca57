"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every
round is a fixed number of key aggregations and skew-safe lookups, its result is
a stored table, and rounds grow with the logarithm of the longest path.  Labels
are the smallest node of the component.  Nothing but sums and fewer than
a thousand hot keys reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import lookup_join
from loomgraph.operators.workspace import Workspace


def _is_star(e: DataFrame) -> bool:
    """Every larger end has one smaller end, and no smaller end is a larger one elsewhere."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    worst = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.col("down"))).first()[0]
    return worst is None or worst <= 1


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, component)``.

    Undirected; self-loops, repeats and rows with a null end are ignored. Only nodes
    of some proper edge are returned. No edges: no rows.
    """
    e = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if _is_star(e):
            break
        # Large star: every node hands the least of its neighbourhood to its larger neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.save(
            both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0").select(F.col("u").alias("v"), "m", "n"),
            "large",
        )
        large = ws.save(lookup_join(e, least, ["v"], "n").select("u", F.col("m").alias("v")).distinct(), "spread")
        # Small star: every node hands the least of its smaller neighbours to the others.
        low = ws.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        moved = lookup_join(large, low, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.save(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        ws.drop(e, least, large, low)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
