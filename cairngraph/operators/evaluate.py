"""Grading, coverage, grounding, audits and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IDENTITY_KEYS, LANGUAGES
from .spread import spread


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Rounded to 4; 0 when nothing is right."""
    return F.when(tp == 0, F.lit(0.0)).otherwise(F.round(2.0 * tp / (2.0 * tp + fp + fn), 4))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def row_identity(rows: DataFrame, task: str = "task") -> DataFrame:
    """task, identity: the first identity key that every row carries with values that don't repeat; null if none does."""
    present = [k for k in IDENTITY_KEYS if k in rows.columns]
    checks = rows.groupBy(task).agg(*[((F.count(k) == F.count(F.lit(1))) & (F.countDistinct(k) == F.count(F.lit(1)))).alias(k) for k in present])
    return checks.select(task, F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in present], F.lit(None).cast("string")).alias("identity"))


def grade_keyed(expected: DataFrame, got: DataFrame, identity: str, details: list[str], task: str = "task") -> DataFrame:
    """Per task: tp, fp, fn, precision, recall, f1 and matched rows whose details agree.

    Predicted rows without identity, and repeats of one, are false positives; the first of repeats (by ``place``) is compared.
    """
    want = expected.groupBy(task, identity).agg(F.min(F.struct(*details)).alias("want"))
    have = got.groupBy(task, identity).agg(F.min_by(F.struct(*details), "place").alias("have"), F.count(F.lit(1)).alias("rows"))
    both = want.join(have.where(F.col(identity).isNotNull()), [task, identity], "full_outer")
    matched = F.col("want").isNotNull() & F.col("have").isNotNull()
    counts = both.groupBy(task).agg(F.count_if(matched).alias("tp"), F.count_if(F.col("have").isNull()).alias("fn"), F.count_if(F.col("want").isNull()).alias("extra"), F.count_if(matched & F.col("want").eqNullSafe(F.col("have"))).alias("details_ok"))
    total = have.groupBy(task).agg((F.sum("rows") - F.count(identity)).alias("surplus"))
    rows = counts.join(total, task, "left").withColumn("fp", F.col("extra") + F.coalesce("surplus", F.lit(0)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(task, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), "details_ok")


def overlap(expected: DataFrame, got: DataFrame, item: str, task: str = "task") -> DataFrame:
    """Multiset overlap: an item counts as often as both sides have it."""
    a = expected.groupBy(task, item).agg(F.count(F.lit(1)).alias("a"))
    b = got.groupBy(task, item).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, [task, item], "full_outer").na.fill(0, ["a", "b"])
    sums = both.groupBy(task).agg(F.sum(F.least("a", "b")).alias("tp"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("fn"))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def coverage(reads: DataFrame, sizes: DataFrame, parts: int = 1) -> DataFrame:
    """run and its widest slice: anchor, direction, prop, distinct ids obtained, true size and share.  Runs are dealt to ``parts`` tasks.

    reads: run, anchor, direction, prop, id.  sizes: anchor, direction, prop, size.  The numerator counts entities and the
    denominator edges, so a slice with multiple edges stays below 1.
    """
    got = spread(reads, parts, "run").groupBy("run", "anchor", "direction", "prop").agg(F.countDistinct("id").alias("obtained"))
    joined = got.join(sizes, ["anchor", "direction", "prop"]).withColumn("share", F.round(F.col("obtained") / F.col("size"), 4))
    best = joined.groupBy("run").agg(F.max_by(F.struct("anchor", "direction", "prop", "obtained", "size", "share"), F.struct("size", "obtained", -F.col("anchor"), "direction", "prop")).alias("w"))
    return best.select("run", "w.*")


def grounding(quotes: DataFrame, stored: DataFrame, reads: DataFrame) -> DataFrame:
    """quotes (quote, entity, language, text) with a verdict.

    UNCHECKED: no entity, or one that isn't stored.  NOT_VERBATIM: no stored text equals it.  GROUNDED: it was read in a
    language whose text equals it.  BLIND: right but never read.  stored: entity, language, text; reads: entity, language.
    """
    known = stored.select("entity", F.lit(True).alias("known")).distinct()
    equal = stored.withColumnRenamed("language", "in_language").join(reads.select("entity", F.col("language").alias("in_language"), F.lit(True).alias("seen")).distinct(), ["entity", "in_language"], "left")
    hit = quotes.join(equal, ["entity", "text"]).groupBy("quote").agg(F.max(F.coalesce("seen", F.lit(False))).alias("seen"))
    rows = quotes.join(known, "entity", "left").join(hit, "quote", "left")
    verdict = F.when(F.col("known").isNull(), "UNCHECKED").when(F.col("seen").isNull(), "NOT_VERBATIM").when(F.col("seen"), "GROUNDED").otherwise("BLIND")
    return rows.select(*[c for c in quotes.columns], verdict.alias("verdict"))


def seen_text(log: DataFrame) -> DataFrame:
    """run, entity, language of the texts that calls put before a reader; log: run, fn, args, ids.

    A description shows the language that it asks for, or all; labels ground nothing, so other calls show none.
    """
    everything = F.array(*[F.lit(x) for x in LANGUAGES])
    shown = F.when(F.col("fn").isin("descriptions", "describe"), everything).when(F.col("fn").isin("entity", "search_entity"), F.array(F.lit("en")))
    shown = shown.when(F.col("fn") == "description", F.when(F.size("args") > 1, F.array(F.get("args", 1))).otherwise(everything))
    rows = log.select("run", F.explode("ids").alias("entity"), shown.alias("shown")).where(F.col("shown").isNotNull() & F.col("entity").rlike(r"^Q\d+$"))
    return rows.select("run", "entity", F.explode("shown").alias("language")).distinct()


def gold_audit(rows: DataFrame, nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """check, n over gold rows (task, qid, name, evidence, language, listed, counted): what the graph contradicts."""
    n = nodes.select("qid", F.col("label_en").alias("_label"), F.lit(True).alias("_known"))
    texts = stored.select(F.col("entity").alias("qid"), "language", F.col("text").alias("_text"))
    by_language = rows.join(n, "qid", "left").join(texts, ["qid", "language"], "left")
    any_text = texts.groupBy("qid").agg(F.collect_set("_text").alias("_texts"))
    full = by_language.join(any_text, "qid", "left")
    known, evidence = F.col("_known").isNotNull(), F.col("evidence").isNotNull()
    checks = {
        "qid_absent": F.col("qid").isNull(), "not_in_graph": F.col("qid").isNotNull() & ~known, "name_vs_label_en": known & F.col("name").isNotNull() & ~F.col("name").eqNullSafe(F.col("_label")),
        "evidence_unattributed": evidence & F.col("qid").isNull(), "evidence_not_stored": evidence & known & ~F.coalesce(F.array_contains("_texts", F.col("evidence")), F.lit(False)),
        "evidence_lang_absent": evidence & known & F.col("language").isNull(), "lang_not_available": known & F.col("language").isNotNull() & F.col("_text").isNull(), "count_mismatch": F.col("counted").isNotNull() & (F.col("counted") != F.col("listed")),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))
    return full.select(found.alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def last_runs(runs: DataFrame, order: str, task: str = "task") -> DataFrame:
    """The last run of each task, by a pre-aggregated maximum."""
    rest = [c for c in runs.columns if c != task]
    return runs.groupBy(task).agg(F.max_by(F.struct(*rest), order).alias("r")).select(task, "r.*")


def compare(before: DataFrame, after: DataFrame, task: str = "task") -> DataFrame:
    """One row: fixed, broken, unchanged, only in either, compared; a null score is in none of the first three."""
    both = before.select(task, F.col("exact").alias("a"), F.lit(True).alias("in_a")).join(after.select(task, F.col("exact").alias("b"), F.lit(True).alias("in_b")), task, "full_outer")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return both.agg(
        F.count_if(shared & ~F.col("a") & F.col("b")).alias("fixed"), F.count_if(shared & F.col("a") & ~F.col("b")).alias("broken"), F.count_if(shared & (F.col("a") == F.col("b"))).alias("unchanged"),
        F.count_if(F.col("in_b").isNull()).alias("only_before"), F.count_if(F.col("in_a").isNull()).alias("only_after"), F.count_if(shared).alias("compared"),
    )


def summary(scores: DataFrame, group: Column | None = None) -> DataFrame:
    """Totals of runs, overall or per group: tasks, exact, content_exact, reached_final, max_iters, turns, reads, tokens."""
    grouped = scores.groupBy(group.alias("pattern")) if group is not None else scores.groupBy()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return grouped.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("exact").alias("exact"), F.count_if("content_exact").alias("content_exact"), F.count_if(F.col("status") == "final").alias("reached_final"), F.count_if(F.col("status") == "max_iters").alias("max_iters"),
        total("turns"), total("reads"), total("tokens"),
    )


def timing(runs: DataFrame, group: str) -> DataFrame:
    """Wall seconds, seconds per call and tokens per second of wall, per group."""
    return runs.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("wall"), 2).alias("total"), F.round(F.median("wall"), 2).alias("median"), F.round(F.max("wall"), 2).alias("longest"), F.round(F.try_divide(F.sum("wall"), F.sum("calls")), 2).alias("per_call"), F.round(F.try_divide(F.sum("tokens"), F.sum("wall")), 2).alias("tokens_per_second"),
    )


def thinking(runs: DataFrame, group: str) -> DataFrame:
    """Share of output tokens spent on reasoning; a share above 1 is impossible and flagged."""
    share = F.try_divide(F.sum("reasoning_tokens"), F.sum("output_tokens"))
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.round(share, 4).alias("share"), F.coalesce(share > 1, F.lit(False)).alias("impossible"))


def task_audit(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per family: tasks, valid contracts, tasks run, last run exact."""
    last = last_runs(runs, "place").select("task", F.col("exact").alias("last_exact"), F.lit(True).alias("ran"))
    return tasks.join(last, "task", "left").groupBy("family").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("valid").alias("valid"), F.count_if("ran").alias("run"), F.count_if("last_exact").alias("exact"))


def turn_pairs(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Assistant messages numbered in order, each with the user message that follows it; system messages are skipped."""
    w = Window.partitionBy(conversation).orderBy(turn)
    rows = messages.where(F.col("role") != "system").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("number", F.sum((F.col("role") == "assistant").cast("int")).over(w))
    return rows.where(F.col("role") == "assistant").select(conversation, "number", F.col("text").alias("reply"), F.when(F.col("next_role") == "user", F.col("next_text")).alias("observation"))
