"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Columns node and component, the smallest node that can be reached, for every node of the edges (a, b), which run
    both ways. Nulls are no nodes; loops and repeated edges do no harm.

    Each round points every node at the smallest of its neighbours (large star, then small star). A node's neighbours are
    only ever reduced to their minimum, before the shuffle, and joined back, so a node with very many is no task's work
    alone; rounds grow with the logarithm of the component's size.
    """
    now = stored(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct(), name)
    nodes = stored(now.select(F.explode(F.array("v", "w")).alias("node")).distinct(), f"{name}-nodes")
    loops = now
    now = stored(loops.filter("v <> w"), name)
    drop(loops)
    before = None
    while True:
        both = now.unionAll(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        # minima are written first: a join with a table can be split where a node is hot, one with an aggregate can't
        least = stored(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m")), f"{name}-least")
        large = stored(both.filter("w > v").join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).filter("v <> w").distinct(), name)
        low = stored(large.groupBy("v").agg(F.min("w").alias("m")), f"{name}-least")
        pairs = F.array(F.struct(F.col("w").alias("v"), F.col("m").alias("w")), F.struct("v", F.col("m").alias("w")))
        small = stored(large.join(low, "v").select(F.explode(pairs).alias("e")).select("e.*").filter("v <> w").distinct(), name)
        drop(now, least, large, low)
        now = small
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    found = now.groupBy("v").agg(F.min("w").alias("m"))
    return nodes.join(found, nodes.node == found.v, "left").select("node", F.coalesce("m", "node").alias("component"))
