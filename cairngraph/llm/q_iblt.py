"""op9: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import iblt
from .scratch import documents


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return iblt.compare(iblt.edited(iblt.with_next(docs, "doc_id", "text"))).withColumnRenamed("key", "doc_id")


QUERIES = {"op9_iblt_fingerprints": op9_iblt_fingerprints}
ORACLES: dict[str, str] = {}
