"""op6: secret spans of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .scratch import documents


def ratios(spark: SparkSession, docs: DataFrame) -> list[float]:
    """The models' table, from generated random strings and ordinary words of a bounded sample of documents."""
    random = secrets.random_strings(spark.range(secrets.RANDOM_STRINGS))
    return secrets.train(random.union(secrets.ordinary_words(docs, "doc_id", "text")))


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.find(docs, "text", ratios(spark, docs))
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.line(F.col("base")), 256).alias("base_sha256"), secrets.line(F.col("spans")).alias("spans"))


QUERIES = {"op6_secret_spans": op6_secret_spans}
ORACLES: dict[str, str] = {}
