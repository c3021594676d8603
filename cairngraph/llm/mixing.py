"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are summed into cells of source, language and topic.  Raking scales the cells'
token weights to the target share of each source, language and topic in turn until all
marginals hold; a document's probability is its cell's weight over its cell's tokens times
a factor, at most 1, with the factor that makes the expected tokens the budget; a document
is kept if a hash of its id falls below its probability.

Cells stay in tables of the shared folder whatever their number; Spark broadcasts them to
the documents if the table is small, and else joins by a shuffle whose skew is split at run
time.

Defined results: null source or language counts as the empty string; a text without words
counts one token; a target for a value that no document has is left out and the others are
scaled up; rows that repeat an id are kept or dropped together; an empty table gives no rows;
input columns are kept in a struct, so their names can't clash; marginals that no weights can
meet together end after ``ROUNDS`` rounds with those of the last dimension met.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import WORD, Scratch, one_task

#: The most rounds, and how far off a marginal share may be.
ROUNDS, TOLERANCE = 40, 1e-12
#: Cells that one task rakes.
ONE_TASK = 100_000
#: Targets are the observed shares to this power, so that small sources gain and a hot one loses.
TEMPER = 0.7
#: Share of all tokens that the sample should hold.
BUDGET = 0.5


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))).cast("long")


def topic(text: Column, words: Column) -> Column:
    """What a document is about as far as its form tells: tables, numbers, long reads, notes or plain prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    bars = size - F.length(F.translate(t, "|", ""))
    digits = size - F.length(F.translate(t, "0123456789", ""))
    return F.when((bars > 0) & (bars * 25 >= size), "table").when((digits > 0) & (digits * 10 >= size), "numbers").when(words >= 1000, "long").when(words < 60, "note").otherwise("prose")


def _target(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """dim and its share of the values that occur: the given targets, else tempered shares of the tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
    if given is None:
        shares = sums.select(dim, F.pow(F.col("tokens") / F.lit(sums.agg(F.sum("tokens")).first()[0]), F.lit(TEMPER)).alias("share"))
    else:
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"`{dim}` string, share double")
        shares = sums.select(dim).join(wanted, dim, "left").na.fill(0.0, ["share"])
    whole = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.select(dim, (F.col("share") / F.lit(whole)).alias(f"share_{dim}"))


def _scaled(cells: DataFrame, dims: list[str], together: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One round: the cells with weights scaled to the shares of each dimension in turn."""
    step = together(cells)
    for dim in dims:
        sums = step.groupBy(dim).agg(F.sum("weight").alias("held"))
        step = together(step.join(sums.hint("merge"), dim)).withColumn("weight", F.when(F.col("held") > 0, F.col("weight") * F.col(f"share_{dim}") / F.col("held")).otherwise(0.0)).drop("held")
    return step


def rake(cells: DataFrame, dims: list[str], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (dims, tokens, share_ of each dim) with weights whose marginals are the shares: a table of ``scratch``.

    Each round sums the weights of every dimension in turn, pre-aggregated, and ends in a written table;
    rounds stop once no marginal is off by more than ``tolerance``.
    """
    now = scratch.write(cells.withColumn("weight", F.col("tokens").cast("double")))
    # few cells are one task's work, which needs no shuffle; the steps are the same
    together = one_task(now.count() <= ONE_TASK)
    for _ in range(rounds):
        step = _scaled(now, dims, together)
        before, now = now, scratch.write(step)
        scratch.drop(before)
        off = [together(now).groupBy(dim).agg(F.abs(F.sum("weight") - F.max(f"share_{dim}")).alias("off")).select("off") for dim in dims]
        if (together(reduce(DataFrame.union, off)).agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return now


def factor(raked: DataFrame, budget: float) -> float:
    """The factor c for which the sum of tokens * min(1, c * weight / tokens) is the budget, or the largest that helps."""
    c, before = 0.0, -1.0
    while c > before:
        before, full = c, F.lit(c) * F.col("weight") >= F.col("tokens")
        sums = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not sums[1]:
            break
        c = (budget - sums[0]) / sums[1]
    return c


def mix(docs: DataFrame, key: str, text: str, source: str, language: str, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), and its source, language, topic, tokens, p (probability) and kept (boolean).

    Cells are a table of the shared folder, whose size decides whether the join broadcasts it.
    """
    dims = ["source", "language", "topic"]
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(language).cast("string"), F.lit("")).alias("language"), tokens(F.col(text)).alias("tokens"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    rows = rows.withColumn("topic", topic(F.col("text"), F.col("tokens"))).drop("text")
    scratch = Scratch(docs.sparkSession, "mixing")
    cells = scratch.write(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if total is None:
        return rows.select("row", *dims, "tokens", F.lit(0.0).alias("p"), F.lit(False).alias("kept"))
    together = one_task(n <= ONE_TASK)
    wanted = together(cells)
    for dim in dims:
        wanted = together(wanted.join(_target(together(cells), dim, (targets or {}).get(dim)), dim))
    raked = rake(wanted, dims, scratch)
    c = factor(raked, BUDGET * total)
    table = scratch.write(raked.select(*dims, F.least(F.lit(1.0), F.lit(c) * F.col("weight") / F.col("tokens")).alias("p")))
    scratch.drop(cells, raked)
    # a hash of the id, uniform on 0 to 1
    place = F.conv(F.substring(F.md5(F.coalesce("key", F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return rows.join(table, dims).select("row", *dims, "tokens", "p", (place < F.col("p")).alias("kept"))
