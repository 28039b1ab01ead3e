"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two shuffles: a partially combined minimum per node, and a join of that minimum with the edges
(large nodes are split by the adaptive skew join). Every round is written to the shared folder, so a lost
executor costs at most one round, and the round before it is deleted. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large star: larger neighbours of a node get its least one. Small star: smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one orderable type); root is the least node reachable."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        after = materialize(_star(_star(now, True), False), label)
        changed = not after.exceptAll(now).isEmpty() or after.count() != now.count()
        release(now)
        now = after
        if not changed:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
