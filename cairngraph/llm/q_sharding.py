"""op7: documents stored in 12 old shards, moved to 16 of equal bytes with the fewest bytes moved; the shards that change are rewritten and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding
from .scratch import Scratch, documents

OLD_SHARDS, NEW_SHARDS, VERSION = 12, 16, 1


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kind, scratch = dict(docs.dtypes)["doc_id"], Scratch(spark, "layout")
    path = scratch.path("shards")
    sharding.write_layout(docs, OLD_SHARDS, path)
    old = sharding.stored(spark, path, kind)
    placed = scratch.write(sharding.reshard(scratch.write(sharding.measured(old)), NEW_SHARDS))
    manifest = scratch.write(sharding.rewrite(spark, placed, path, VERSION, old.select("file", "place", "text")))
    out = sharding.measured(sharding.read_layout(spark, path, VERSION, manifest, placed, kind))
    return out.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


QUERIES = {"op7_reshard": op7_reshard}
ORACLES: dict[str, str] = {}
