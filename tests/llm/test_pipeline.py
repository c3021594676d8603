"""Queries and pipeline over a data folder."""

from __future__ import annotations

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from cairngraph.llm import bpe, minhash
from cairngraph.llm.scratch import documents
from compare import rows, tables

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(n.split("_")[0] for n in entry.queries() if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11))
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = tables(FOLDER).sql(entry.oracle_sql()[name])
    assert got == rows(list(relation.columns), relation.fetchall())


def test_stages(spark, tmp_path):
    docs, seen = documents(spark, FOLDER), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        assert k == 4 or docs.columns == columns
    language, deduped, clean, mixed, encoded = seen
    assert language.count() == documents(spark, FOLDER).count()  # all have letters
    found = minhash.near_duplicates(language, "doc_id", "text", 5, 80).where("id = component_id")
    assert {r[0] for r in deduped.select("doc_id").collect()} == {r["id"] for r in found.collect()}
    assert clean.count() == deduped.count() and clean.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    assert {r[0] for r in mixed.select("doc_id").collect()} == {r[0] for r in encoded.select("doc_id").collect()} and 0 < mixed.count() < clean.count()
    import public_tokenizers as public

    c = bpe.codec(bpe.read_vocabulary(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["ids"] == c.encode(texts[r["doc_id"]]) for r in encoded.collect())
