"""op3: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .scratch import documents, id_mod

FOLDS, HELD_OUT = 4, 2


def learned(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(id_mod(F.col("doc_id"), FOLDS) != HELD_OUT), "text", "lang", F.col("doc_id"))


def op3_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, "doc_id", "text", learned(docs))
    return out.withColumn("held_out", id_mod(F.col("doc_id"), FOLDS) == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_language_families": op3_language_families}
ORACLES: dict[str, str] = {}
