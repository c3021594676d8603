"""op4: pages written as archives, deduplicated by payload, rewritten with revisits and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .scratch import Scratch, delete, pages

MIN_BYTES = 0
#: The query's archives are read back once, so that a better ratio isn't worth its time.
LEVEL = "BEST_SPEED"


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    raw, fresh = scratch.path("raw"), scratch.path("fresh")
    warc.write(pages(spark, sf_dir), "page_id", "url", "html", raw, level=LEVEL)
    decided = scratch.write(warc.resolve(warc.read_headers(spark, raw), MIN_BYTES))
    warc.rewrite(spark, raw, decided, fresh, level=LEVEL)
    delete(spark, raw)
    headers = scratch.write(warc.read_headers(spark, fresh))
    return warc.follow(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_revisits": op4_warc_revisits}
ORACLES: dict[str, str] = {}
