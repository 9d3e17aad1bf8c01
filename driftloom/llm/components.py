"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of edges(u, v); component is the smallest node of its component.

    Each round hooks every node's neighbours to the smallest node around it, then does so for the smaller neighbours
    alone. Stars are joined, not collected; least neighbours are found by partial sums. A hub's own edges, one for each member
    of its component at most, meet in one key, which Spark splits as it does any skewed key of a join. Rounds are stored.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(state):
            break
        mark, now = tuple(state), new
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
