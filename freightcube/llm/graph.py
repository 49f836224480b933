"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) edges over longs -> (node, root), root being the smallest node of its component.

    Rounds of large-star and small-star: every node links its larger neighbours to the
    smallest node it knows, then its smaller ones. Each round is a pair of map-side combined
    minima and joins, written to the shared folder; the number of rounds grows with the logarithm
    of the graph's diameter. Nodes without edges are not in the result.
    """
    spark = edges.sparkSession
    known = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    mark = None
    for _ in range(max_rounds):
        state = known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == mark:
            return known.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                known.select(F.col("v"), F.col("v")).distinct()) if state[0] else spark.createDataFrame([], "node long, root long")
        mark = state
        both = known.union(known.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components not found in {max_rounds} rounds")
