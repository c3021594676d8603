"""op10: byte-level BPE ids of every document, and the bytes they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .scratch import documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
