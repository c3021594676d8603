"""The read log: what a call costs, budgets, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FREE_WHEN_SEEN


def charges(log: DataFrame) -> DataFrame:
    """log (run, seq, fn, args, ids) with ``charged`` and the running ``spent``.

    A call costs 1, except: reads_left; has, name and rank when every id was returned by an earlier call of the run
    (so a miss, with no ids, is free); and edges of a node after one unfiltered call of it in both directions.
    args of edges: id, direction, relation.  Where log has a boolean column ``free`` (reads of a record that is open
    already), calls marked there cost nothing; null counts as not free.
    """
    ids = log.select("run", "seq", F.explode_outer("ids").alias("id"))
    first = ids.where("id is not null").groupBy("run", "id").agg(F.min("seq").alias("first"))
    fresh = ids.join(first, ["run", "id"]).groupBy("run", "seq").agg(F.max(F.col("first") == F.col("seq")).alias("new"))
    full = (F.col("fn") == "edges") & (F.col("args")[1] == "both") & F.coalesce(F.col("args")[2], F.lit("")).isin("", "None")
    before = Window.partitionBy("run", F.col("args")[0]).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.join(fresh, ["run", "seq"], "left").withColumn("new", F.coalesce("new", F.lit(False)))
    repeated = F.coalesce(F.max(full).over(before), F.lit(False)) & (F.col("fn") == "edges")
    cost = (F.col("fn") != "reads_left") & ~(F.col("fn").isin(*FREE_WHEN_SEEN) & ~F.col("new")) & ~F.col("repeated") & (F.col("fn") != "degree")
    if "free" in log.columns:
        cost = cost & ~F.coalesce(F.col("free"), F.lit(False))
    charged = rows.withColumn("repeated", repeated).withColumn("charged", cost.cast("int"))
    return charged.withColumn("spent", F.sum("charged").over(Window.partitionBy("run").orderBy("seq"))).drop("repeated")


def exhausted(charged: DataFrame, budget: int) -> DataFrame:
    """run and the first call at which more than the budget is spent."""
    return charged.where(F.col("spent") > budget).groupBy("run").agg(F.min("seq").alias("seq"))


def reads_left(charged: DataFrame, budget: int) -> DataFrame:
    return charged.groupBy("run").agg(F.greatest(F.lit(0), F.lit(budget) - F.max("spent")).alias("left"))


def seen_ids(log: DataFrame) -> DataFrame:
    return log.select("run", F.explode("ids").alias("id")).distinct()


def ungrounded(answers: DataFrame, log: DataFrame) -> DataFrame:
    """run, id: ids of an answer that no call returned and the question doesn't name; answers: run, ids, question_ids."""
    said = answers.select("run", F.explode(F.array_except("ids", "question_ids")).alias("id"))
    return said.join(seen_ids(log), ["run", "id"], "left_anti")
