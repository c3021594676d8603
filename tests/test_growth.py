"""Steps whose cost must not outgrow the input, and cuts that queries mustn't make."""

from __future__ import annotations

from cairngraph.operators import build, evaluate, hubs, nav, patterns, search, spread
from cairngraph.plans import build_queries, eval_queries, search_queries
from cairngraph.plans.common import Graph
from compare import rows, tables

FOLDER = "/root/testdata/sf0.001"


def test_search_query_ranks_all_that_match(spark, monkeypatch):
    monkeypatch.setattr(search.search_entity, "__defaults__", (10, 1))  # a depth of one hit stands for 4,000 among more
    df = search_queries.search_entity(spark, FOLDER)
    relation = tables(FOLDER).sql(search_queries.ORACLES["search_entity"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(relation.columns), relation.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_members_and_totals_take_one_shuffle(spark):
    rows = [(f, p, s) for f in range(3) for p in range(2) for s in range(3) if f or p != s] + [(0, 0, 2)]
    pools = spark.createDataFrame(rows, "five int, part int, supplier int")
    out = patterns.shared_with_totals(pools, ["five"], "part", "supplier", 2, "suppliers", 4)
    assert sorted(map(tuple, out.collect())) == [(0, 2, 3)] + [(f, s, 3) for f in (1, 2) for s in range(3)]
    assert plan(patterns.shared_with_totals(pools, ["five"], "part", "supplier", 2, "suppliers", 4)).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_tasks_grow_with_the_rows(spark):
    few, many = spark.range(1000), spark.range(10_000_000)
    assert spread.parts(few) == 1 and 70 <= spread.parts(many) <= 80  # 8 bytes a row
    assert spread.spread(few, 1, "id") is few
    assert spread.spread(many, 77, "id").rdd.getNumPartitions() == 77


def test_graph_without_sort_of_hot_targets(spark):
    g = Graph(spark, FOLDER)
    assert spread.parts(g.raw_edges, 1) < 10_000_000  # of unlimited size while the classes were a local list
    assert "SortMergeJoin" not in plan(g.edges)
    assert "SortMergeJoin" not in plan(nav.Policy(types=(104,)).allowed(g.edges, build.degrees(g.edges)))


def test_degrees_build_the_edges_once(spark):
    edges = spark.createDataFrame([(1, 5, 2), (2, 5, 2), (1, 6, 3)], "src long, prop int, dst long")
    assert sorted(map(tuple, build.degrees(edges).collect())) == [(1, 2, 0), (2, 1, 2), (3, 0, 1)]
    assert plan(build.degrees(edges)).split("Initial Plan")[-1].count("Scan ExistingRDD") == 1


def test_answers_of_a_small_file_are_parsed_in_many_tasks(spark):
    for query in (eval_queries.graded_answers, eval_queries.exact_canonical):
        assert query(spark, FOLDER).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_observations_need_only_edges_of_hubs(spark):
    edges = spark.createDataFrame([(1, 5, 2), (2, 5, 3), (3, 6, 1), (3, 6, 3)], "src long, prop int, dst long")
    near = hubs.incident(edges, spark.createDataFrame([(1, "out", 5), (1, "in", 6)], "hub long, direction string, prop int"))
    assert sorted(map(tuple, near.collect())) == [(1, 5, 2), (3, 6, 1)]


def test_coverage_is_dealt_by_run(spark):
    reads = spark.createDataFrame([(1, 7, "out", 6, 3), (1, 7, "out", 6, 3), (1, 8, "out", 6, 4), (2, 7, "out", 6, 9)], "run int, anchor long, direction string, prop int, id long")
    sizes = spark.createDataFrame([(7, "out", 6, 2), (8, "out", 6, 4)], "anchor long, direction string, prop int, size long")
    want = [(1, 8, "out", 6, 1, 4, 0.25), (2, 7, "out", 6, 1, 2, 0.5)]
    assert sorted(map(tuple, evaluate.coverage(reads, sizes, 9).collect())) == sorted(map(tuple, evaluate.coverage(reads, sizes).collect())) == want


def test_first_lines_are_shuffled_without_derived_texts(spark):
    line = spark.createDataFrame([(1, 1, 5, "b"), (1, 1, 4, "c"), (1, 2, 9, "a"), (2, 1, 3, "d")], "o int, l int, p int, t string")
    assert sorted(map(tuple, build.first_rows(line, ["o", "l"], ["p"], 5).collect())) == [(1, 1, 4, "c"), (1, 2, 9, "a"), (2, 1, 3, "d")]
    text = plan(build_queries.statement_first_row(spark, FOLDER)).split("Initial Plan")[-1]
    below = text[text.index("Exchange"):]
    assert "wikibase" not in below and "yyyy-MM-dd" not in below
