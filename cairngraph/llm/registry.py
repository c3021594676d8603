"""Queries and oracle SQL of this subpackage, gathered from its query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_bpe, q_iblt, q_langid, q_minhash, q_mixing, q_secrets, q_sharding, q_tiff, q_toxicity, q_warc

MODULES = (q_minhash, q_tiff, q_langid, q_warc, q_mixing, q_secrets, q_sharding, q_toxicity, q_iblt, q_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
