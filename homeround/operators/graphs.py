"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeround.storage import forget, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; the component is its smallest node.

    ``edges``: columns a, b (long). Each round links every larger neighbour of a node to the smallest
    node that it sees, then every smaller one; the number of edges never grows, and the rounds needed
    are logarithmic in the diameter. Minima are pre-aggregated before the shuffle and joined back, so
    that a node with very many edges is a skewed join that the adaptive planner splits, not one task.
    Each round's edges are a written table.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("v"))  # only neighbours larger than the node move
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        step = written(large, "large-star")
        low = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "small-star")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        forget(step)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
