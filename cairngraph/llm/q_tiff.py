"""op2: every document's text stored as a TIFF page, read back and described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiff
from .scratch import documents


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.from_text(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    # the unpadded size travels in the key, as a page row carries only its key
    keyed = files.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("n_bytes").cast("string")).alias("file"), "media")
    out = tiff.features(tiff.pages(keyed, "file", "media"), ["file", "media_bytes", "media_sha256"])
    file = F.split("file", ":")
    return out.select(
        F.when(file[0] != "-", file[0]).cast("long").alias("doc_id"), file[1].cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


QUERIES = {"op2_tiff_media": op2_tiff_media}
ORACLES: dict[str, str] = {}
