"""Connected components by alternating large-star and small-star steps over DataFrames.

Every step is a pre-aggregated minimum per node joined back to its edges, so a node
with very many neighbours never gathers them in one task (the join's skew is split at
run time).  Each round is written to the shared folder, which cuts the lineage and
survives lost executors.  Few edges take the same steps in one task, without shuffles or
broadcasts, so that small rounds don't cost the driver a plan of many tasks each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, one_task

#: Edges that one task takes through a round.
ONE_TASK = 100_000


def _large_star(edges: DataFrame, together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = together(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return together(both.where("b > a").join(least.hint("merge"), "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joins a node's smaller neighbours, and itself, to the smallest of them; edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = together(edges.join(least.hint("merge"), "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return together(down.union(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    The result is a table of ``scratch``.  ``edges`` has long columns a and b in any direction; self loops and repeats are harmless;
    no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.write(e)
    # a round has at most two edges for each of these
    together = one_task(now.count() <= ONE_TASK)
    mark_before = None
    while True:
        after = scratch.write(_small_star(_large_star(together(now), together), together))
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == mark_before:
            break
        mark_before = mark
    # a star forest now: every edge is (node, smallest)
    out = scratch.write(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    scratch.drop(now)
    return out
