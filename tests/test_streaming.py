from __future__ import annotations

from cairngraph import agent
from cairngraph.facade import GraphClient
from cairngraph.operators import ledger as batch
from cairngraph.operators.nav import Policy
from cairngraph.streaming import ledger


def test_charges_of_a_stream_equal_the_sequential_log(spark, tmp_path):
    calls = [("r1", 0, "edges", "Q1", True), ("r1", 1, "name", "Q1", False), ("r1", 2, "edges", "Q1", False), ("r1", 3, "has", None, False), ("r2", 0, "name", "Q1", False), ("r1", 4, "claims", "Q2", False)]
    schema = "run string, seq long, fn string, id string, full boolean"
    for n, part in enumerate((calls[:3], calls[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ledger.charge_stream(ledger.arriving(spark, str(tmp_path / "in"), schema))
        ledger.resume(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == (3, 6)[n]
    log = agent.ReadLog()
    for _, _, fn, i, full in (c for c in calls if c[0] == "r1"):
        log.add(fn, [i, "both" if full else "out", None], [i] if i else [])
    rows = {(r["run"], r["seq"]): r["spent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["r1", 4] == log.spent == 2 and rows["r2", 0] == 1


def test_windowed_reads(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "fn string, t string").selectExpr("fn", "timestamp(t) AS ts").write.parquet(str(tmp_path / "in"))
    stream = ledger.windowed_reads(ledger.arriving(spark, str(tmp_path / "in"), "fn string, ts timestamp"))
    stream.writeStream.format("memory").queryName("reads").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["calls"] for r in spark.table("reads").collect()) == [1, 2]


def test_client(spark):
    nodes = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "qid long, label_en string")
    edges = spark.createDataFrame([(1, 5, 2), (1, 6, 3), (3, 5, 1), (1, 5, 1)], "src long, prop int, dst long")
    g = GraphClient(nodes, edges, budget=10)
    assert g.has("Q1") and not g.has("bad") and g.name("Q2") == "two" and g.degree("Q1") == (3, 2)
    assert g.count_edges("Q1") == {"out": 2, "in_": 1, "total": 3}
    assert g.edges("Q1")["out"] == [("P5", "Q2", "two"), ("P6", "Q3", "three")]
    assert g.neighbors("Q1", 5) == [("P5", "Q2", "two")] and g.backlinks("Q1") == [("P5", "Q3", "three")]
    assert g.stats()["edges"] == 4 and g.log.spent == 4
    banned = GraphClient(nodes, edges, policy=Policy(nodes=(3,)))
    assert banned.edges("Q1")["in_"] == []
    try:
        banned.edges("Q3")
        raise AssertionError
    except KeyError:
        pass


def test_client_records(spark):
    nodes = spark.createDataFrame([(1, "one", 9), (2, "two", 9)], "qid long, label_en string, class_id int")
    edges = spark.createDataFrame([(1, 5, 2)], "src long, prop int, dst long")
    claims = spark.createDataFrame([(1, 5, 2, "normal", 0), (1, 6, 2, "deprecated", 1)], "subject long, prop int, value long, rank string, place int")
    sources = spark.createDataFrame([(1, 5, 2, "P248", "Q7"), (1, 5, 2, "P248", "Q7"), (1, 6, 2, None, None)], "subject long, prop int, value long, source_prop string, source string")
    records = spark.createDataFrame([(1, 9, "one", "un", None, "first", "")], "qid long, class_id int, label_en string, label_fr string, label_de string, description_en string, description_fr string")
    names = spark.createDataFrame([(5, "en", "part of"), (5, "fr", "partie de"), (50, "en", "parting"), (6, "de", "Teil")], "pid int, language string, label string")
    g = GraphClient(nodes, edges, claims, sources=sources, records=records, property_labels=names)
    assert g.claims("Q1") == [{"property": "P5", "property_label": "part of", "value": "Q2", "value_label": "two", "rank": "normal"}]
    assert [c["property"] for c in g.claims("Q1", all_ranks=True)] == ["P5", "P6"] and g.claims("Q1", 6) == []
    assert g.references("Q1") == [{"property": "P5", "property_label": "part of", "value": "Q2", "sources": [{"property": "P248", "value": "Q7"}]}]
    assert g.entity("Q1") == {"id": "Q1", "label": "one", "description": "first", "instance_of": 9, "properties": ["P5", "P6"], "n_properties": 2}
    assert set(g.describe("Q1")["languages"]) == {"en", "fr"} and set(g.describe("Q1", ("de", "fr"))["languages"]) == {"fr"}
    assert g.label("Q1", "fr") == "un" and g.label("Q1", "de") is None and g.labels("Q1") == {"en": "one", "fr": "un"}
    assert g.description("Q1") == "first" and g.descriptions("Q1") == {"en": "first"}
    assert g.log.spent == 1 and "Q2" in g.log.seen  # all of one record
    assert g.search_property(" ") == (0, []) and g.log.spent == 1
    assert g.search_property("Part") == (2, [{"pid": "P5", "label": "part of", "lang": "en"}, {"pid": "P50", "label": "parting", "lang": "en"}]) and g.log.spent == 2
    for call in (g.claims, g.references, g.entity, g.describe, g.labels):
        try:
            call("Q3")
            raise AssertionError
        except KeyError:
            pass
    assert g.log.spent == 2
    g.degree("Q2")
    assert g.log.calls[-1]["ids"] == ["Q2"]


def test_calls_marked_free_cost_nothing(spark, tmp_path):
    schema = "run string, seq long, fn string, args array<string>, ids array<string>, free boolean"
    calls = [("r", 0, "claims", ["Q1"], ["Q1"], False), ("r", 1, "entity", ["Q1"], ["Q1"], True), ("r", 2, "label", ["Q2"], ["Q2"], None)]
    rows = batch.charges(spark.createDataFrame(calls, schema)).orderBy("seq").collect()
    assert [r["spent"] for r in rows] == [1, 1, 2]
    flat = "run string, seq long, fn string, id string, full boolean, free boolean"
    spark.createDataFrame([(r, n, fn, args[0], False, free) for r, n, fn, args, _, free in calls], flat).coalesce(1).write.parquet(str(tmp_path / "in"))
    ledger.resume(ledger.charge_stream(ledger.arriving(spark, str(tmp_path / "in"), flat)), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert [r["spent"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()] == [1, 1, 2]
