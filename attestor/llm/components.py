"""Connected components of an edge table by alternating star contractions.

Every round hangs the larger neighbours of a node on its smallest one, then all smaller
ones; both are aggregations with map-side combine and an equi-join, so no component, hub or
edge list is ever gathered. The number of rounds grows with the logarithm of the longest
chain. The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Nodes must be orderable and not null; loops and repeated edges are fine. Nodes without
    an edge do not appear, an empty table gives an empty result.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        current = materialize(small.where("a <> b").distinct())
        count, total = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == (count, total):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (count, total)
