"""Operators that SQL doesn't cover, and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairngraph.functions import canonical, ids, text
from cairngraph.operators import build, evaluate, hubs, nav, semantic, traverse
from cairngraph.plans import eval_queries


def test_item_numbers(spark):
    df = spark.createDataFrame([("Q42",), ("P15",), ("q1",), ("Q1x",), ("",), (None,), ("Q",)], "s string")
    assert [r[0] for r in df.select(ids.item_number(F.col("s"))).collect()] == [42, -1, -1, -1, -1, -1, -1]
    assert ids.parse_item("Q7") == 7 and ids.parse_item(7) == 7
    with pytest.raises(KeyError):
        ids.parse_item("P7")


def test_fold_and_typography(spark):
    df = spark.createDataFrame([("Gerhard Schröder ß Ærø ǆ łódź",)], "s string")
    assert df.select(text.fold(F.col("s"))).first()[0] == "Gerhard Schroder ss Ærø ǆ łodz"
    quotes = spark.createDataFrame([("‘a’ “b” c–d e",)], "s string")
    assert quotes.select(text.typographic(F.col("s"))).first()[0] == "'a' \"b\" c-d e"


def test_canonical_is_stable_and_ignores_order():
    a = {"b": [3, 1.0, "q5", 1], "a": "it’s  so", "o": {"ordered": [2, 1]}}
    b = {"o": {"ordered": [2, 1]}, "a": "it's so", "b": ["Q5", 1, 3, 1]}
    assert canonical.canonical(a) == canonical.canonical(b)
    assert canonical.canonical(canonical.canonical(a)) == canonical.canonical(a)
    assert canonical.canonical([1, 1, 2]) == [1, 1, 2] != canonical.canonical([1, 2, 2])
    assert canonical.canonical({"ordered": [1, 2]}) != canonical.canonical({"ordered": [2, 1]})
    assert canonical.canonical({"ordered": [1, 2]}, ordered=False) == canonical.canonical({"ordered": [2, 1]}, ordered=False)
    assert canonical.grade_fields({"a": None}, {}) == {"a": True}
    assert canonical.parse_answer("```json\n{\"a\": 1}\n```") == {"a": 1}
    with pytest.raises(canonical.InvalidAnswer):
        canonical.parse_answer("{")
    assert canonical.field_diff({"a": 1, "b": 2}, {"a": 1.0, "c": 3}) == ["b", "c"]
    assert canonical.grade_fields({"x": "A"}, {"x": "A", "y": 1}) == {"x": True, "y": False}


def test_scoped_strings_inherit_and_refuse_ambiguity():
    tree = {"qid": "Q1", "lang": "fr", "rows": [{"evidence": "a"}, {"qid": "Q2", "lang": "de", "text": "b"}], "pair": {"x": {"qid": "Q3"}, "y": {"qid": "Q4"}, "evidence": "c"}}
    assert sorted(canonical.scoped_strings(tree), key=str) == sorted([("Q1", "fr", "a"), ("Q2", "de", "b"), ("Q1", "fr", "c")], key=str)


def test_scoped_strings_know_all_keys_of_scope():
    assert [*canonical.scoped_strings({"entity": "Q5", "evidence": " t ", "evidence_language": "fr"})] == [("Q5", "fr", "t")]
    assert [*canonical.scoped_strings({"entity": {"qid": "Q6"}, "text": "u", "id": "x1", "lang": "longer"})] == [("Q6", None, "u")]


def test_grade_scores_lists_and_excludes_bookkeeping():
    want = {"rows": [{"qid": "Q1", "n": 1}, {"qid": "Q2", "n": 2}], "who": {"a": 1}, "total": 2, "examined": 7}
    out = canonical.grade(want, want | {"rows": [{"qid": "q2", "n": 2}, {"qid": "Q1", "n": 9}, "stray"], "examined": 8}, ["examined"])
    assert (out["set_f1"], out["scalars_ok"], out["content_exact"], out["fields"]["rows"]["detail_ok"]) == (0.8, "2/3", False, "1/2")
    assert canonical.grade(want, want | {"examined": 8}, ["examined"])["content_exact"] is True
    assert canonical.grade([1, 1], [1])["set_f1"] == 0.0 and canonical.grade({"x": [1, 1, 2]}, {"x": [1, 2, 2]})["set_f1"] == 0.6667


def test_components_and_closure_match_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)]
    nodes = sorted({x for e in edges for x in e} | {999})
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    e = spark.createDataFrame(edges, "src long, dst long").withColumn("prop", F.lit(1))
    n = spark.createDataFrame([(x,) for x in nodes], "qid long")
    assert {r[0]: r[1] for r in traverse.components(n, e).select("qid", "component").collect()} == {x: find(x) for x in nodes}
    seen = {r[0] for r in traverse.closure(spark.createDataFrame([(405,)], "qid long"), e).collect()}
    assert seen == {x for x in nodes if find(x) == 400}


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "qid long, label_en string"), spark.createDataFrame([], "src long, prop int, dst long")
    assert build.with_degrees(nodes, edges).count() == 0
    assert build.build_counters(edges, nodes).first().asDict() == {"raw": 0, "boundary_dropped": 0, "repeats_dropped": 0, "kept": 0}
    assert nav.edges_page(edges, nodes, spark.createDataFrame([(1,)], "anchor long")).count() == 0
    assert nav.count_edges(edges, spark.createDataFrame([(1,)], "anchor long")).first()["total"] == 0


def test_page_rules(spark):
    edges = spark.createDataFrame([(1, 5, d) for d in range(1, 8)], "src long, prop int, dst long")
    nodes = spark.createDataFrame([(d, f"n{d}") for d in range(1, 8)], "qid long, label_en string")
    one = spark.createDataFrame([(1,)], "anchor long")
    page = lambda **k: [(r["other"], r["truncated"]) for r in nav.edges_page(edges, nodes, one, "out", **k).orderBy("place").collect()]
    assert page(limit=2, offset=1) == [(3, True), (4, True)]  # the self loop is hidden
    assert page(limit=3, offset=3) == [(5, False), (6, False), (7, False)]
    assert len(page(limit=0)) == 6 and page(limit=2, offset=-4)[0] == (2, True)


def test_policy_bans(spark):
    edges = spark.createDataFrame([(1, 31, 9), (2, 5, 1), (2, 6, 3), (3, 5, 2), (4, 5, 3)], "src long, prop int, dst long")
    degrees = build.degrees(edges)
    left = lambda p: {tuple(r) for r in p.allowed(edges, degrees).select("src", "prop", "dst").collect()}
    assert left(nav.Policy(types=(9,))) == {(2, 6, 3), (3, 5, 2), (4, 5, 3)}
    assert left(nav.Policy(relations=(5,), nodes=(4,))) == {(1, 31, 9), (2, 6, 3)}
    assert left(nav.Policy(max_degree=2)) == {(1, 31, 9)}


def test_stable_hash_value(spark):
    assert int(spark.range(42, 43).select(hubs.stable_hash(F.col("id"), 0)).first()[0]) == 42 * 11400714819323198485 % 2**64


def test_overlap_and_compare_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "task int, item string")
    b = spark.createDataFrame([(1, "x"), (1, "z")], "task int, item string")
    r = evaluate.overlap(a, b, "item").first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 2, 0.4)
    before = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "task string, exact boolean")
    after = spark.createDataFrame([("a", True), ("b", True), ("d", True)], "task string, exact boolean")
    assert evaluate.compare(before, after).first().asDict() == {"fixed": 0, "broken": 0, "unchanged": 1, "only_before": 1, "only_after": 1, "compared": 2}


def test_embed_uses_the_cache_and_scales(spark):
    texts = spark.createDataFrame([("aa",), ("b",), ("b",), (None,)], "t string")
    cache = spark.createDataFrame([("b", [1.0, 0.0])], "text string, vector array<double>")
    got = {r["text"]: r["vector"] for r in semantic.embed(texts, "t", lambda part: [[3.0, 4.0] for _ in part], cache).collect()}
    assert got == {"b": [1.0, 0.0], "aa": [0.6, 0.8]}


def test_scout_finds_a_bridge_or_stops(spark):
    edges = spark.createDataFrame([(1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 5), (8, 5, 9)], "src long, prop int, dst long")
    close = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3, 4, 5)] + [(8, [0.0, 1.0]), (9, [0.0, 1.0])], "qid long, embedding array<double>")
    assert semantic.scout(1, 5, edges, close)["path"] == [1, 2, 3, 4, 5]
    assert semantic.scout(1, 8, edges, close)["status"] == "no gradient"


def test_smallest_shortest_path(spark):
    parents = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (3, 4), (4, 4)], "child long, parent long")
    rows = traverse.ancestor_paths(spark.createDataFrame([(1,)], "anchor long"), parents, 3).where("ancestor = 4").collect()
    assert [(r["distance"], r["path"]) for r in rows] == [(2, [1, 2, 4])]


FOLDER = "/root/testdata/sf0.001"


def test_grounding_verdict_holds_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(eval_queries.evaluate, "grounding", lambda *a, f=evaluate.grounding: seen.append(a) or f(*a))
    eval_queries.grounding_verdict(spark, FOLDER)
    whole = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    quotes, stored, _ = seen[0]
    assert {r["entity"]: r["text"] for r in stored.collect()} == whole
    assert {r["quote"]: r["text"] for r in quotes.collect()} == {i: t + "!" if i % 5 == 0 else t for i, t in whole.items()}
