"""Every operator and stage on tables with odd ids, repeats, clashing names, long texts, and on none."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairngraph.llm import bpe, iblt, langid, minhash, mixing, q_langid, q_secrets, secrets, sharding, tiff, toxicity, warc

LONG = "some words of a long text, with token = \"0123456789abcdef0123456789abcdef\" inside.\n" * 6000
IDS = [0, -7, 5_000_000_000, 9_223_372_036_854_775_807, -9_223_372_036_854_775_808, None]
ROWS = [(i, f"the words of the text number {i} are these, and they are of some length", "en", "web") for i in IDS]
ROWS += [(1, "the same row twice over and over", "en", "web")] * 2 + [(2, None, None, None), (3, "", "en", None), (4, "1 2 3", "fr", "web"), (5, LONG, "en", "code"), (6, LONG, "en", "code")]
CLASHING = ["_lang_pred", "_spans", "_place", "_mix_kept", "row", "key", "id", "language", "score", "found", "clean", "p", "kept", "tokens", "topic", "place", "part", "component_id"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


OPERATORS = {
    "minhash": lambda d: minhash.near_duplicates(d, "doc_id", "text"),
    "tiff": lambda d: tiff.pages(tiff.from_text(d, "doc_id", "text"), "doc_id", "media"),
    "langid": lambda d: langid.identify(d, "doc_id", "text", q_langid.learned(d)),
    "mixing": lambda d: mixing.mix(d, "doc_id", "text", "source", "lang"),
    "secrets": lambda d: secrets.find(d, "text", q_secrets.ratios(d.sparkSession, d)).select("row", "spans"),
    "sharding": lambda d: sharding.reshard(sharding.from_documents(d, 3), 4),
    "toxicity": lambda d: toxicity.scores(d, "doc_id", "text", toxicity.train(d.withColumn("label", F.lit(1)), "text", "label", F.col("doc_id"))),
    "iblt": lambda d: iblt.compare(iblt.edited(iblt.with_next(d, "doc_id", "text"))),
    "bpe": lambda d: bpe.round_trip(d, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_a_row_for_each_row(spark, name):
    assert len(OPERATORS[name](table(spark)).collect()) == len(ROWS)
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_archives_give_a_record_for_each_row(spark, tmp_path):
    for k, rows in enumerate((ROWS, [])):
        df = table(spark, rows).withColumn("url", F.lit("http://a/b"))
        raw, fresh = f"file://{tmp_path}/raw{k}", f"file://{tmp_path}/fresh{k}"
        warc.write(df, "doc_id", "url", "text", raw)
        warc.rewrite(spark, raw, warc.resolve(warc.read_headers(spark, raw)), fresh)
        assert warc.follow(warc.read_headers(spark, fresh)).count() == len(rows)


#: Rows that each stage keeps, by id: letters for the language, one of each group and id for the duplicates, all for the secrets.
KEPT = {
    "language ID": [*IDS, 1, 1, 5, 6], "MinHash near-dedup": [*IDS, 1, 2, 3, 4, 5], "secret scans": [r[0] for r in ROWS],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_keeps_columns_of_any_name(spark, name, stage):
    d = table(spark)
    out = stage(spark, d, "")
    rows = out.collect()
    if name.startswith("byte-level"):
        assert len(rows) == len(ROWS)
    else:
        assert out.columns == d.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
        assert name not in KEPT or order(r["doc_id"] for r in rows) == order(KEPT[name])
    if name == "secret scans":
        assert all("0123456789abcdef" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in rows)
    empty = stage(spark, table(spark, []), "")
    assert empty.columns == out.columns and empty.collect() == []


def test_without_any_language_all_texts_with_letters_stay(spark):
    d = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, d, "").count() == len(KEPT["language ID"])
