"""Shared working tables, session helpers and hashes used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reach

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and bytes, of one Arrow batch; a larger row is a batch of its own.
ROWS, BYTES = 1000, 4 << 20
#: A key that holds more than this part of the rows is hot, so there are fewer hot keys than its inverse; and the parts that a hot key is dealt in.
HOT, DEALT = 0.002, 64
#: Words of the corpus contracts: runs without space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or our own where it is unset and one machine does all (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairngraph-"))
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and are dropped once superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        # the id stays valid while the frame is referenced by the caller
        out._scratch_path = path
        return out

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{label}"

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and by bytes, so that a worker holds a few MB of text at a time, and let workers find this package.

    Settings are read when a plan runs, so they stay; smaller ones of the session are kept.
    """
    reach(spark)
    for name, most in ((BATCH, ROWS), (BATCH_BYTES, BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(name).split("b")[0]) or 0) if not spark.conf.get(name).startswith("-") else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def dealt_join(many: DataFrame, one: DataFrame, key: str, by: str, counted: DataFrame) -> DataFrame:
    """``many`` joined to the rows of ``one`` by ``key``, of which ``one`` has each once: hot keys are dealt in DEALT parts by ``by``, and their row of ``one`` is copied to each.

    ``counted`` is a written table with the keys of ``many``.  At most 1 / HOT keys are broadcast.
    """
    least = max(1000, int(counted.count() * HOT))
    hot = F.broadcast(counted.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > least).select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(DEALT)).cast("int")).otherwise(0)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, key, "left").withColumn("_part", part).drop("_hot")
    right = one.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_part"]).drop("_part")


def one_task(few: bool) -> Callable[[DataFrame], DataFrame]:
    """What brings few rows to one task, and leaves many as they are; to be put on joins and unions too, whose results Spark else shuffles though they are in one partition."""
    return (lambda df: df.coalesce(1)) if few else (lambda df: df)


def id_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
