"""The read log and statement batches as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..schema import FREE_WHEN_SEEN


def arriving(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Files that appear below ``path``; with a checkpoint and ``availableNow`` a restarted scan reads only new ones."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def resume(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends everything that arrived since the last call, and ends."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_reads(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls per window and function; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "fn").agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), "fn", "calls")


def charge_stream(log: DataFrame) -> DataFrame:
    """run, seq, charged, spent of a stream of calls (run, seq, fn, id, full, and free if there is such a column): the rules of the ledger with state per run.

    State holds the ids seen and the nodes fully expanded; it grows with what one run has read, which its budget bounds.
    Calls of a run must arrive in order of ``seq`` across batches; within a batch they are sorted here.
    """
    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, opened, spent = (set(state.get[0]), set(state.get[1]), state.get[2]) if state.exists else (set(), set(), 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        marked = rows["free"] if "free" in rows else [False] * len(rows)
        for seq, fn, i, full, given in zip(rows["seq"], rows["fn"], rows["id"], rows["full"], marked, strict=True):
            fresh = isinstance(i, str) and i not in seen
            free = given == 1 or fn in ("reads_left", "degree") or (fn in FREE_WHEN_SEEN and not fresh) or (fn == "edges" and i in opened)
            seen |= {i} if isinstance(i, str) else set()
            opened |= {i} if fn == "edges" and full else set()
            spent += not free
            out.append((key[0], int(seq), int(not free), spent))
        state.update((sorted(seen), sorted(opened), spent))
        yield pd.DataFrame(out, columns=["run", "seq", "charged", "spent"])

    return log.groupBy("run").applyInPandasWithState(step, "run string, seq long, charged int, spent long", "seen array<string>, opened array<string>, spent long", "append", GroupStateTimeout.NoTimeout)
