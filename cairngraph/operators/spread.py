"""How many tasks a step is dealt to, told from what its sources hold.

Spark merges shuffle partitions by their compressed bytes.  Graph keys compress well, so that a task gets
many millions of rows, and more as the input grows; and a small file is one task, whatever its rows cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Estimated bytes of one task's rows: some 250,000 to 350,000 edges.
TASK_BYTES = 1 << 20


def parts(source: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for the rows of a plan without joins, by Spark's own estimate of its bytes (from file sizes, no job runs): in proportion to the input, one if all fits."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // task_bytes)


def parsed(source: DataFrame, key: str) -> DataFrame:
    """Rows of a small file whose texts Python parses, dealt to all that runs at once: it costs far more than to read them."""
    return source.repartition(max(parts(source, 256 << 10), 2 * source.sparkSession.sparkContext.defaultParallelism), key)


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt to ``n`` tasks by ``keys``, and to no fewer than run at once; as they are if one task would do."""
    return df if n <= 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)
