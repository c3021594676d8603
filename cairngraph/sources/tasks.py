"""Task contracts, run archives and environment files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("id", "question", "taxonomy", "allowed_functions", "limits", "answer")


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def contract_faults(task: Any, functions: Iterable[str]) -> list[str]:
    """Everything that breaks the task contract; an empty list is a valid task."""
    if not isinstance(task, dict):
        return ["a task is one JSON object"]
    absent = [k for k in REQUIRED if k not in task]
    if absent:
        return [f"missing: {', '.join(absent)}"]
    faults = [f"{k} must be a non-empty text" for k in ("id", "question") if not _text(task[k])]
    allowed, taxonomy, limits, answer = task["allowed_functions"], task["taxonomy"], task["limits"], task["answer"]
    if not isinstance(allowed, list) or not all(isinstance(x, str) for x in allowed):
        faults.append("allowed_functions must list names")
    elif unknown := sorted(set(allowed) - set(functions)):
        faults.append(f"unknown functions: {', '.join(unknown)}")
    if not isinstance(taxonomy, dict) or not all(_text(taxonomy.get(k)) for k in ("category", "type")):
        faults.append("taxonomy needs category and type")
    if not isinstance(limits, dict) or set(limits) != {"turns"}:
        faults.append("limits must hold turns only")
    elif isinstance(limits["turns"], bool) or not isinstance(limits["turns"], int) or limits["turns"] < 1:
        faults.append("limits.turns must be a positive integer")
    if not isinstance(answer, dict):
        faults.append("answer must be an object")
    else:
        faults += [f"answer.{k} must be a non-empty text" for k in ("schema", "format") if not _text(answer.get(k))]
        faults += ["answer.expected is missing"] * ("expected" not in answer)
    if "reference_path" in task and not isinstance(task["reference_path"], list):
        faults.append("reference_path must be a list")
    return faults


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task, family, category, turns, expected (JSON text) of all JSON files below ``path``; whole files, one object each."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("file", F.input_file_name())
    get = lambda p: F.get_json_object("value", p)
    return files.select("file", get("$.id").alias("task"), F.element_at(F.split("file", "/"), -2).alias("family"), get("$.taxonomy.category").alias("category"), get("$.limits.turns").cast("int").alias("turns"), get("$.answer.expected").alias("expected"), F.col("value").alias("raw"))


def valid_contract() -> Column:
    """The contract's shape as a column predicate over ``raw``, for audits of many tasks."""
    out = F.lit(True)
    for p in ("$.id", "$.question", "$.taxonomy.category", "$.taxonomy.type", "$.allowed_functions", "$.limits.turns", "$.answer.schema", "$.answer.format", "$.answer.expected"):
        out = out & (F.coalesce(F.get_json_object("raw", p), F.lit("")) != "")
    return out


def discover(root: str | Path, families: Iterable[str], per_family: int | None = None) -> list[Path]:
    """Sorted task files of each family, at most ``per_family`` of each, without repeats."""
    found = [f for family in families for f in sorted(Path(root, family).glob("*.json"))[:per_family]]
    return list(dict.fromkeys(found))


def env_files(*paths: str | Path, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE settings: the process environment wins, then earlier files, then defaults."""
    out = dict(defaults or {})
    for path in reversed(paths):
        if Path(path).exists():
            lines = (x.strip() for x in Path(path).read_text().splitlines())
            out |= {k.strip(): v.strip().strip("\"'") for k, _, v in (x.removeprefix("export ").partition("=") for x in lines if x and not x.startswith("#") and "=" in x)}
    return {k: os.environ.get(k, v) for k, v in out.items()}


def archive(spark: SparkSession, path: str, run: str, metadata: dict, messages: list[dict], reads: list[dict]) -> None:
    """Appends a run to the tables runs, messages and read_log below ``path``; readers take the last row of a run."""
    spark.createDataFrame([(run, json.dumps(metadata, sort_keys=True))], "run string, metadata string").write.mode("append").parquet(f"{path}/runs")
    if messages:
        spark.createDataFrame([(run, i, m["role"], m["content"]) for i, m in enumerate(messages)], "run string, turn int, role string, text string").write.mode("append").parquet(f"{path}/messages")
    if reads:
        spark.createDataFrame([(run, i, r["fn"], [str(a) for a in r["args"]], [str(x) for x in r["ids"]]) for i, r in enumerate(reads)], "run string, seq int, fn string, args array<string>, ids array<string>").write.mode("append").parquet(f"{path}/read_log")


def catalogue(spark: SparkSession, path: str, tasks: DataFrame, scores: DataFrame) -> DataFrame:
    """Runs with their task and score, newest name first; a run without either keeps nulls."""
    from ..functions.text import task_of_run

    runs = spark.read.parquet(f"{path}/runs").withColumn("task", task_of_run(F.col("run")))
    return runs.join(tasks.select("task", "family", "category"), "task", "left").join(scores, "run", "left").orderBy(F.desc("run"))


def resolve_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """run, task: the stated task if it exists, else the only task named like the run, else null; runs: run, stated."""
    from ..functions.text import task_of_run

    known = tasks.groupBy("task").count()
    stem = runs.withColumn("stem", task_of_run(F.col("run")))
    by_stated = stem.join(known.select(F.col("task").alias("stated"), F.lit(True).alias("exists")), "stated", "left")
    single = known.where("count = 1").select(F.col("task").alias("stem"), F.lit(True).alias("single"))
    return by_stated.join(single, "stem", "left").select("run", F.when(F.col("exists"), F.col("stated")).when(F.col("single"), F.col("stem")).alias("task"))
