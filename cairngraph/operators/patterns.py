"""Query shapes over pools of members: set operations, rankings, audits, partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose ``on`` columns occur in b, once."""
    return a.select(on).distinct().join(b.select(on), on, "left_semi")


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_anti")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_by_all(pools: DataFrame, group: list[str], hub: str, member: str, n: int) -> DataFrame:
    """Members that belong to all n hubs of their group: one pre-aggregated count, no n-way join."""
    return pools.groupBy(*group, member).agg(F.countDistinct(hub).alias("hubs")).where(F.col("hubs") == n).drop("hubs")


def shared_with_totals(pools: DataFrame, group: list[str], hub: str, member: str, n: int, total: str, parts: int = 1) -> DataFrame:
    """``shared_by_all`` with its group's number of distinct members: the pools are dealt by group to ``parts`` tasks once, and counted, totalled and filtered there."""
    counts = spread(pools, parts, *group).groupBy(*group, member).agg(F.countDistinct(hub).alias("hubs"))
    return counts.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*group))).where(F.col("hubs") == n).drop("hubs")


def top_with_ties(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """All rows with their group's largest value; the rank bound becomes a group limit below the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(value)) if group else None
    if w is None:
        best = counts.agg(F.max(value).alias("_best"))
        return counts.join(F.broadcast(best), F.col(value) == F.col("_best")).drop("_best")
    return counts.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def unanswered(edges: DataFrame, prop: int) -> DataFrame:
    """Reciprocity audit: (src, dst) of a relation that no (dst, src) answers; self loops answer themselves."""
    e = edges.where(F.col("prop") == prop).select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_anti")


def without_fact(members: DataFrame, edges: DataFrame, prop: int, key: str = "qid") -> DataFrame:
    """Missing-fact audit: members with no edge of the relation."""
    return members.join(edges.where(F.col("prop") == prop).select(F.col("src").alias(key)), key, "left_anti")


def partition_counts(members: DataFrame, hub: str, group: Column) -> DataFrame:
    """Members per hub and group, with an explicit ``unstated`` group; counts add up to ``pool``."""
    rows = members.withColumn("part", F.coalesce(group, F.lit("unstated"))).groupBy(hub, "part").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("pool", F.sum("n").over(Window.partitionBy(hub)))


def compare_hubs(pool: DataFrame, hub: str, verdict: Column) -> DataFrame:
    """One row: judged counts of all hubs in the pool, and the winner (smallest hub among ties)."""
    counts = pool.groupBy(hub).agg(F.count_if(verdict).alias("n"))
    return counts.agg(F.max("n").alias("most"), F.max_by(hub, F.struct("n", -F.col(hub))).alias("winner"), F.sum("n").alias("total"))


def disambiguate(nodes: DataFrame, label: str, edges: DataFrame, prop: int, target: Column) -> DataFrame:
    """Nodes that share a label, kept when a relation leads to a target."""
    same = nodes.where(F.col("label_en") == label)
    return same.join(edges.where((F.col("prop") == prop) & target).select(F.col("src").alias("qid")), "qid", "left_semi")


def chain(pool: DataFrame, keep: Column, edges: DataFrame, prop: int, nodes: DataFrame) -> DataFrame:
    """Filter a pool (hub, member, text) by its text, follow a relation of the members, and give the targets' labels."""
    kept = pool.where(keep).select("hub", "member")
    steps = kept.join(edges.where(F.col("prop") == prop).select(F.col("src").alias("member"), F.col("dst").alias("target")), "member")
    return steps.join(nodes.select(F.col("qid").alias("target"), F.col("label_en").alias("target_label")), "target", "left")


def conflicts(facts: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities whose facts in several languages disagree."""
    return facts.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("stated")).where("least <> most")
