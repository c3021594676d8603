"""op5: raked sampling probabilities of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .scratch import documents


def op5_mixture_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"), "doc_id", "text", "source", "lang")
    return out.select("row.doc_id", "source", "language", "topic", "tokens", F.round("p", 9).alias("p"), "kept")


def _sql() -> str:
    """The same rounds as a chain of common table expressions."""
    steps, last = [], "w0"
    for r in range(mixing.ROUNDS):
        for dim in ("source", "language", "topic"):
            name = f"w{3 * r + ('source', 'language', 'topic').index(dim) + 1}"
            steps.append(f"{name} AS (SELECT source, language, topic, tokens, t_source, t_language, t_topic, w * t_{dim} / sum(w) OVER (PARTITION BY {dim}) AS w FROM {last})")
            last = name
    shares = ", ".join(f"s_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM cells), {mixing.TEMPER}) AS s FROM cells GROUP BY {d}), n_{d} AS (SELECT {d}, s / (SELECT sum(s) FROM s_{d}) AS t_{d} FROM s_{d})" for d in ("source", "language", "topic"))
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS language,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens FROM documents
), sizes AS (
  SELECT *, length(text) AS n, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits FROM words
), docs AS (
  SELECT doc_id, source, language, tokens,
         CASE WHEN bars > 0 AND bars * 25 >= n THEN 'table' WHEN digits > 0 AND digits * 10 >= n THEN 'numbers'
              WHEN tokens >= 1000 THEN 'long' WHEN tokens < 60 THEN 'note' ELSE 'prose' END AS topic FROM sizes
), cells AS (SELECT source, language, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL
), {shares}, w0 AS (
  SELECT c.*, t_source, t_language, t_topic, c.tokens::DOUBLE AS w FROM cells c JOIN n_source USING (source) JOIN n_language USING (language) JOIN n_topic USING (topic)
), {", ".join(steps)}, ratios AS (
  SELECT source, language, topic, tokens, w, w / tokens AS ratio, row_number() OVER (ORDER BY w / tokens DESC, source, language, topic) AS place FROM {last}
), sums AS (
  SELECT *, {mixing.BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ratios
), factor AS (SELECT rest / open AS c FROM sums WHERE rest / open * ratio <= 1 ORDER BY place LIMIT 1
), probabilities AS (SELECT source, language, topic, least(1.0, (SELECT c FROM factor) * ratio) AS p FROM ratios)
SELECT doc_id, d.source, d.language, d.topic, d.tokens, round(p, 9) AS p,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM docs d JOIN probabilities q ON d.source = q.source AND d.language = q.language AND d.topic = q.topic
"""


QUERIES = {"op5_mixture_raking": op5_mixture_raking}
ORACLES = {"op5_mixture_raking": _sql()}
