"""Bounded paths, ancestors, closures and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Steps:
    """Frontiers written to the cluster's shared checkpoint folder: loops keep short lineages and survive lost executors."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        root = self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", self.spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="cairngraph-")
        self.root, self.n = f"{root.rstrip('/')}/steps-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ancestor_paths(anchors: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """anchor, ancestor, distance and path (lexicographically smallest of the shortest) up to ``depth`` steps; the anchor itself is at 0.

    parents: child, parent.  The depth is small and known, so the steps are unrolled into one plan.
    """
    now = anchors.select("anchor", F.col("anchor").alias("ancestor"), F.lit(0).alias("distance"), F.array("anchor").alias("path"))
    levels = [now]
    edges = parents.where("child <> parent").distinct()
    for d in range(1, depth + 1):
        step = levels[-1].join(edges, F.col("ancestor") == F.col("child")).where(~F.expr("array_contains(path, parent)"))
        step = step.groupBy("anchor", F.col("parent").alias("ancestor")).agg(F.min(F.concat("path", F.array("parent"))).alias("path"))
        levels.append(step.select("anchor", "ancestor", F.lit(d).alias("distance"), "path"))
    every = reduce(DataFrame.union, levels)
    best = every.groupBy("anchor", "ancestor").agg(F.min(F.struct("distance", "path")).alias("b"))
    return best.select("anchor", "ancestor", "b.distance", "b.path")


def common_ancestors(pairs: DataFrame, parents: DataFrame, depth: int = 4) -> DataFrame:
    """a, b, ancestor, distance and both paths of the nearest common ancestors of each pair; ties are all kept."""
    anchors = pairs.select(F.col("a").alias("anchor")).union(pairs.select(F.col("b").alias("anchor"))).distinct()
    paths = ancestor_paths(anchors, parents, depth)
    left = paths.select(F.col("anchor").alias("a"), "ancestor", F.col("distance").alias("d_a"), F.col("path").alias("path_a"))
    right = paths.select(F.col("anchor").alias("b"), "ancestor", F.col("distance").alias("d_b"), F.col("path").alias("path_b"))
    met = pairs.join(left, "a").join(right, ["b", "ancestor"]).withColumn("distance", F.col("d_a") + F.col("d_b"))
    near = met.withColumn("_rank", F.rank().over(Window.partitionBy("a", "b").orderBy("distance"))).where("_rank = 1")
    return near.select("a", "b", "ancestor", "distance", "path_a", "path_b")


def nearest_matching(anchors: DataFrame, parents: DataFrame, nodes: DataFrame, matches: Column, depth: int) -> DataFrame:
    """anchor, ancestor and distance of the nearest proper ancestors whose node satisfies ``matches``.

    The frontier drops anchors as soon as they have a match, so it shrinks with every step.
    """
    steps = Steps(anchors)
    edges = steps.keep(parents.where("child <> parent").distinct())
    good = steps.keep(nodes.where(matches).select(F.col("qid").alias("ancestor")))
    front = anchors.select("anchor", F.col("anchor").alias("at"))
    found = []
    for d in range(1, depth + 1):
        front = steps.keep(front.join(edges, F.col("at") == F.col("child")).select("anchor", F.col("parent").alias("at")).distinct())
        if front.isEmpty():
            break
        hit = steps.keep(front.join(good, F.col("at") == F.col("ancestor")).select("anchor", "ancestor", F.lit(d).alias("distance")))
        found.append(hit)
        front = front.join(hit.select("anchor").distinct(), "anchor", "left_anti")
    if not found:
        return anchors.select("anchor", F.col("anchor").alias("ancestor"), F.lit(0).alias("distance")).where(F.lit(False))
    return reduce(DataFrame.union, found)


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """qid of everything reachable from the seeds (qid) over undirected edges: the frontier meets the edges, what was seen goes."""
    steps = Steps(seeds)
    kept = steps.keep(edges.select("src", "dst").where("src <> dst"))
    both = steps.keep(kept.union(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    front = seen = steps.keep(seeds.select("qid").distinct())
    while True:
        front = steps.keep(both.join(front, F.col("src") == F.col("qid"), "left_semi").select(F.col("dst").alias("qid")).distinct().join(seen, "qid", "left_anti"))
        if front.isEmpty():
            return seen
        seen = steps.keep(seen.union(front))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid and component (its smallest qid) of all nodes over undirected edges, by hooking to the smallest neighbour and pointer jumping.

    The number of rounds grows with the logarithm of the longest chain; every round is two joins on pre-aggregated minima.
    """
    steps = Steps(nodes)
    both = steps.keep(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = steps.keep(nodes.select("qid", F.col("qid").alias("label")))
    before = None
    while True:
        # smallest label among a component's neighbours, hooked onto the component's own label
        offered = both.join(labels, F.col("src") == F.col("qid")).select(F.col("dst").alias("qid"), F.col("label").alias("offer"))
        least = offered.join(labels, "qid").groupBy(F.col("label").alias("root")).agg(F.min("offer").alias("offer")).where("offer < root")
        hooked = labels.join(least, F.col("label") == F.col("root"), "left").select("qid", F.coalesce("offer", "label").alias("label"))
        hooked = steps.keep(hooked)
        jump = hooked.select(F.col("qid").alias("label"), F.col("label").alias("further"))
        labels = steps.keep(hooked.join(jump, "label", "left").select("qid", F.coalesce("further", "label").alias("label")))
        mark = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return labels.withColumnRenamed("label", "component")
        before = mark


def certified_absence(a: int, b: int, edges: DataFrame) -> DataFrame:
    """One row: whether b is outside a's component, and the component's size (the certificate is ``closure``)."""
    seeds = edges.sparkSession.createDataFrame([(a,)], "qid long")
    return closure(seeds, edges).agg(F.coalesce(~F.bool_or(F.col("qid") == b), F.lit(True)).alias("absent"), F.count(F.lit(1)).alias("component_size"))


def smallest_paths(anchors: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Lexicographically smallest shortest path from each anchor to every node within ``depth`` steps along edges."""
    return ancestor_paths(anchors, edges.select(F.col("src").alias("child"), F.col("dst").alias("parent")), depth)
