"""Queries of pools, audits, rankings and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build, nav, patterns, traverse
from ..operators.spread import parts
from .common import GRAPH, NODES, Graph


def _supplied(g: Graph):
    """part p, hub (0: the part, 1: the next part), supplier: pools of neighbouring parts."""
    e = g.relation(7)
    own = e.select(F.col("src").alias("p"), F.lit(0).alias("hub"), F.col("dst").alias("supplier"))
    return own, e.select((F.col("src") - 1).alias("p"), F.lit(1).alias("hub"), F.col("dst").alias("supplier"))


def pool_intersection(spark, sf_dir):
    a, b = _supplied(Graph(spark, sf_dir))
    return patterns.intersection(a, b, ["p", "supplier"])


def pool_difference(spark, sf_dir):
    a, b = _supplied(Graph(spark, sf_dir))
    return patterns.difference(a, b, ["p", "supplier"])


def shared_hub(spark, sf_dir):
    """Suppliers that all five parts of a window of five share, and each window's independent total."""
    g = Graph(spark, sf_dir)
    pools = g.relation(7).select(F.floor((F.col("src") - 30000000) / 5).alias("five"), F.col("src").alias("part"), F.col("dst").alias("supplier"))
    return patterns.shared_with_totals(pools, ["five"], "part", "supplier", 5, "suppliers", parts(g.raw_edges.where("prop = 7")))


def union_missing_columns(spark, sf_dir):
    g = Graph(spark, sf_dir)
    a = g.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return patterns.union_by_name(a, g.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


def _parts_of_orders(g: Graph):
    counts = g.relation(5).groupBy(F.col("src").alias("order_id")).agg(F.count(F.lit(1)).alias("parts"))
    placed = g.relation(4).select(F.col("src").alias("order_id"), F.col("dst").alias("customer"))
    lives = g.relation(2).select(F.col("src").alias("customer"), F.col("dst").alias("nation"))
    return counts.join(placed, "order_id").join(lives, "customer")


def rank_pool_ties(spark, sf_dir):
    """For every nation, the orders of its customers with the most distinct parts, ties kept."""
    return patterns.top_with_ties(_parts_of_orders(Graph(spark, sf_dir)), ["nation"], "parts").select("nation", "order_id", "parts")


def argmax_overall(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return patterns.top_with_ties(g.relation(7).groupBy(F.col("dst").alias("supplier")).agg(F.count(F.lit(1)).alias("parts")), [], "parts")


def reciprocity_audit(spark, sf_dir):
    return patterns.unanswered(Graph(spark, sf_dir).relation(12), 12)


def missing_fact_audit(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return patterns.without_fact(g.nodes.where("class_id = 103").select("qid", "label_en"), g.relation(13), 13)


def partition_unstated(spark, sf_dir):
    g = Graph(spark, sf_dir)
    members = g.table("customer").select(F.col("c_nationkey").alias("nation"), "c_mktsegment", "c_acctbal")
    return patterns.partition_counts(members, "nation", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))


def compare_hubs(spark, sf_dir):
    g = Graph(spark, sf_dir)
    pool = g.table("customer").where("c_nationkey in (0, 1, 2)").withColumn("hub", F.col("c_nationkey"))
    return patterns.compare_hubs(pool, "hub", F.col("c_acctbal") >= 1000)


def homonyms(spark, sf_dir):
    """Parts that share a name, told apart by a relation to the first supplier."""
    g = Graph(spark, sf_dir)
    return patterns.disambiguate(g.nodes, "red widget", g.relation(7), 7, F.col("dst") < 20000010)


def chain_relay(spark, sf_dir):
    """Customers of a nation filtered by segment, their orders' priority pool followed to parts."""
    g = Graph(spark, sf_dir)
    placed = nav.pool(g.relation(4), g.nodes.where("class_id = 103").select(F.col("qid").alias("hub")), 4, "in")
    texts = g.table("orders").select((F.col("o_orderkey") + 40000000).alias("member"), F.col("o_orderpriority").alias("text"))
    return patterns.chain(placed.join(texts, "member"), F.col("text").contains("URGENT"), g.relation(6), 6, g.nodes)


def multilingual_conflict(spark, sf_dir):
    """Sources whose first number differs between the languages of their documents."""
    docs = Graph(spark, sf_dir).table("documents")
    number = F.regexp_extract("text", "([0-9]{2,6})", 1)
    facts = docs.select(F.col("source").alias("entity"), F.col("lang").alias("language"), "doc_id", F.when(number != "", number.cast("long")).alias("value")).where("value is not null")
    first = facts.groupBy("entity", "language").agg(F.min_by("value", "doc_id").alias("value"))
    return patterns.conflicts(first, "entity", "value")


def _parents(g: Graph):
    return g.relation(10).select(F.col("src").alias("child"), F.col("dst").alias("parent"))


def common_ancestor(spark, sf_dir):
    """Every part with the next one, up to four steps of the parent tree."""
    g = Graph(spark, sf_dir)
    pairs = g.nodes.where("class_id = 105").select(F.col("qid").alias("a"), (F.col("qid") + 1).alias("b"))
    out = traverse.common_ancestors(pairs, _parents(g), 4)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return out.select("a", "b", "ancestor", "distance", text("path_a"), text("path_b"))


def nearest_matching_ancestor(spark, sf_dir):
    """For every part, the nearest part above it whose name has the word bolt."""
    g = Graph(spark, sf_dir)
    anchors = g.nodes.where("class_id = 105").select(F.col("qid").alias("anchor"))
    return traverse.nearest_matching(anchors, _parents(g), g.nodes.where("class_id = 105"), F.col("label_en").rlike(r"\bbolt\b"), 40)


def kinship_component(spark, sf_dir):
    """Everything reachable from one customer over the chain relation."""
    g = Graph(spark, sf_dir)
    return traverse.closure(spark.createDataFrame([(10000035,)], "qid long"), g.relation(11))


def chain_components(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return traverse.components(g.nodes.where("class_id = 103").select("qid"), g.relation(11))


def certified_absence(spark, sf_dir):
    return traverse.certified_absence(10000035, 10000041, Graph(spark, sf_dir).relation(11))


QUERIES = {f.__name__: f for f in (
    pool_intersection, pool_difference, shared_hub, union_missing_columns, rank_pool_ties, argmax_overall, reciprocity_audit, missing_fact_audit, partition_unstated, compare_hubs, homonyms, chain_relay,
    multilingual_conflict, common_ancestor, nearest_matching_ancestor, kinship_component, chain_components, certified_absence,
)}

_POOLS = f"WITH {GRAPH}, a AS (SELECT src AS p, dst AS supplier FROM edges WHERE prop = 7), b AS (SELECT src - 1 AS p, dst AS supplier FROM edges WHERE prop = 7)"
_CHAIN = f"WITH RECURSIVE {GRAPH}, u AS (SELECT src, dst FROM edges WHERE prop = 11 UNION SELECT dst, src FROM edges WHERE prop = 11)"
ORACLES = {
    "pool_intersection": f"{_POOLS} SELECT * FROM a INTERSECT SELECT * FROM b",
    "pool_difference": f"{_POOLS} SELECT * FROM a EXCEPT SELECT * FROM b",
    "shared_hub": f"""WITH {GRAPH}, p AS (SELECT (src - 30000000) // 5 AS five, src AS part, dst AS supplier FROM edges WHERE prop = 7), t AS (SELECT five, count(DISTINCT supplier) AS suppliers FROM p GROUP BY 1)
        SELECT five, supplier, suppliers FROM p JOIN t USING (five) GROUP BY ALL HAVING count(DISTINCT part) = 5""",
    "union_missing_columns": "SELECT c_custkey AS key, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "rank_pool_ties": f"""WITH {GRAPH}, c AS (SELECT src AS o, count(*) AS parts FROM edges WHERE prop = 5 GROUP BY 1), j AS (SELECT n.dst AS nation, c.o AS order_id, parts FROM c JOIN edges p ON p.prop = 4 AND p.src = c.o JOIN edges n ON n.prop = 2 AND n.src = p.dst)
        SELECT nation, order_id, parts FROM (SELECT *, rank() OVER (PARTITION BY nation ORDER BY parts DESC) AS r FROM j) WHERE r = 1""",
    "argmax_overall": f"WITH {GRAPH}, c AS (SELECT dst AS supplier, count(*) AS parts FROM edges WHERE prop = 7 GROUP BY 1) SELECT * FROM c WHERE parts = (SELECT max(parts) FROM c)",
    "reciprocity_audit": f"WITH {GRAPH} SELECT src, dst FROM edges e WHERE prop = 12 AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.prop = 12 AND b.src = e.dst AND b.dst = e.src)",
    "missing_fact_audit": f"WITH {GRAPH} SELECT qid, label_en FROM nodes WHERE class_id = 103 AND qid NOT IN (SELECT src FROM edges WHERE prop = 13)",
    "partition_unstated": """WITH p AS (SELECT c_nationkey AS nation, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'unstated') AS part, count(*) AS n FROM customer GROUP BY 1, 2)
        SELECT *, (sum(n) OVER (PARTITION BY nation))::BIGINT AS pool FROM p""",
    "compare_hubs": """WITH c AS (SELECT c_nationkey AS hub, count(*) FILTER (c_acctbal >= 1000) AS n FROM customer WHERE c_nationkey IN (0, 1, 2) GROUP BY 1)
        SELECT max(n) AS most, (SELECT hub FROM c ORDER BY n DESC, hub LIMIT 1) AS winner, sum(n)::BIGINT AS total FROM c""",
    "homonyms": f"WITH {GRAPH} SELECT qid, label_en, class_id FROM nodes WHERE label_en = 'red widget' AND qid IN (SELECT src FROM edges WHERE prop = 7 AND dst < 20000010)",
    "chain_relay": f"""WITH {GRAPH} SELECT c.dst AS hub, c.src AS member, s.dst AS target, n.label_en AS target_label FROM edges c JOIN orders o ON c.src = o.o_orderkey + 40000000 AND o.o_orderpriority LIKE '%URGENT%'
        JOIN edges s ON s.prop = 6 AND s.src = c.src JOIN nodes n ON n.qid = s.dst WHERE c.prop = 4""",
    "multilingual_conflict": """WITH f AS (SELECT source AS entity, lang, doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{2,6})', 1), '') AS BIGINT) AS value FROM documents),
        g AS (SELECT entity, lang, min_by(value, doc_id) AS value FROM f WHERE value IS NOT NULL GROUP BY 1, 2) SELECT entity, min(value) AS least, max(value) AS most, count(*) AS stated FROM g GROUP BY 1 HAVING min(value) <> max(value)""",
    "common_ancestor": f"""WITH RECURSIVE {NODES}, walk AS (SELECT qid AS anchor, qid AS ancestor, 0 AS distance, qid::VARCHAR AS path FROM nodes WHERE class_id = 105
        UNION ALL SELECT anchor, 30000000 + (ancestor - 30000000) // 2, distance + 1, concat(path, '>', 30000000 + (ancestor - 30000000) // 2) FROM walk WHERE distance < 4 AND ancestor > 30000000),
        m AS (SELECT a.anchor AS a, b.anchor AS b, a.ancestor, a.distance + b.distance AS distance, a.path AS path_a, b.path AS path_b FROM walk a JOIN walk b ON b.anchor = a.anchor + 1 AND a.ancestor = b.ancestor)
        SELECT a, b, ancestor, distance, path_a, path_b FROM (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY distance) AS r FROM m) WHERE r = 1""",
    "nearest_matching_ancestor": f"""WITH RECURSIVE {NODES}, walk AS (SELECT qid AS anchor, qid AS ancestor, 0 AS distance FROM nodes WHERE class_id = 105
        UNION ALL SELECT anchor, 30000000 + (ancestor - 30000000) // 2, distance + 1 FROM walk WHERE ancestor > 30000000)
        SELECT anchor, ancestor, distance FROM (SELECT w.*, rank() OVER (PARTITION BY anchor ORDER BY distance) AS r FROM walk w JOIN nodes n ON n.qid = w.ancestor AND regexp_matches(n.label_en, '\\bbolt\\b') WHERE distance > 0) WHERE r = 1""",
    "kinship_component": f"{_CHAIN}, c AS (SELECT 10000035::BIGINT AS qid UNION SELECT u.dst FROM c JOIN u ON u.src = c.qid) SELECT qid FROM c",
    "chain_components": "SELECT 10000000 + c_custkey AS qid, 10000000 + (c_custkey // 10) * 10 AS component FROM customer",
    "certified_absence": f"{_CHAIN}, c AS (SELECT 10000035::BIGINT AS qid UNION SELECT u.dst FROM c JOIN u ON u.src = c.qid) SELECT NOT bool_or(qid = 10000041) AS absent, count(*) AS component_size FROM c",
}
