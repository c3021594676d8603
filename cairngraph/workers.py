"""Makes this package importable in Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' path, for sessions whose workers start elsewhere; on a cluster the package is installed or sent along, and the entry is harmless."""
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in have:
        environment["PYTHONPATH"] = ":".join([ROOT, *have])
