"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.storage import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (a != b) as ``(node, root)``, root the smallest node reachable. Nodes are of any type
    that has an order, such as numbers or structs.

    Alternating star contractions: every node hooks onto the smallest neighbour seen, so long chains halve in each
    round and the edge list never grows. Each round is checkpointed in the shared folder. Aggregations are map-side
    combined; the joins of a hub's links with its smallest neighbour are plain inner joins with one row a node on one side, which
    adaptive execution splits where a hub makes a partition large. Nodes without edges aren't returned.
    """
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        # large star: neighbours larger than u hook onto the smallest of u and its neighbours
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: smaller neighbours and u itself hook onto the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = checkpointed(links.where("u != v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
