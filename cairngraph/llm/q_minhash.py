"""op1: near-duplicate components of all documents on 2-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .scratch import documents


def op1_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", words=2, threshold=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "class_id")


QUERIES = {"op1_minhash_components": op1_minhash_components}
ORACLES: dict[str, str] = {}
