"""op8: toxicity of every document, learned from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .scratch import documents, id_mod, labels

FOLDS, HELD_OUT, LEVEL = 3, 1, 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marks = labels(spark, sf_dir).where(id_mod(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = toxicity.pick(marks, "toxic", F.col("doc_id"))
    model = toxicity.train(docs.join(F.broadcast(picked), "doc_id"), "text", "toxic", F.col("doc_id"))
    out = toxicity.scores(docs, "doc_id", "text", model)
    return out.select("doc_id", (id_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
