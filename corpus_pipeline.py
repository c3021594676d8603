"""From raw documents to token ids: language, near duplicates, secrets, mixture, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm import bpe, langid, minhash, mixing, q_langid, q_secrets, secrets
from cairngraph.llm.q_bpe import VOCABULARY
from cairngraph.llm.scratch import Scratch, documents

#: A prediction below this is a rejection; texts of a learned language score far above it.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without letters, or far from every machine's sure side, go.

    Null and empty texts have no letters and go; if no row has a language, nothing was learned and every text
    with a letter stays; rows that repeat are judged alike; an empty table stays empty; columns of any name are kept.
    """
    model = q_langid.learned(docs)
    tagged = langid.tag(docs, "text", model)
    if not model.families:
        return tagged.where(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    return tagged.where((F.col("language") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on five-word shingles at 0.8: that of the smallest id.

    Null and blank texts link with nothing and stay; rows without an id stay; of rows that repeat an id one
    stays; an empty table stays empty; columns of any name are kept.
    """
    return minhash.one_of_each(docs, "doc_id", "text", words=5, threshold=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by a mark; n_chars follows the new text.

    A text without secrets stays as it is, null or empty too, and keeps its n_chars; repeated rows are treated
    alike; an empty table stays empty; columns of any name are kept.
    """
    found = secrets.find(docs, "text", q_secrets.ratios(spark, docs))
    any_found = F.size("spans") > 0
    fresh = found.select("row", any_found.alias("found"), secrets.redacted("text", "spans").alias("clean"))
    changed = {"text": F.when(F.col("found"), F.col("clean")).otherwise(F.col("row.text")), "n_chars": F.when(F.col("found"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return fresh.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the target shares of source, language and topic.

    Null source, language and text count as empty; rows that repeat an id are kept or go together; an empty
    table stays empty; columns of any name are kept.
    """
    return mixing.mix(docs, "doc_id", "text", "source", "lang").where("kept").select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to.

    Null text encodes as the empty text; repeated rows give repeated results; an empty table stays empty;
    columns besides id and text are left out.
    """
    return bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), documents(spark, sf_dir), None
    for _, stage in STAGES:
        out = scratch.write(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        docs = last = out
    return docs


#: The models and the encoder can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
