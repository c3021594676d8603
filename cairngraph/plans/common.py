"""The graph of a data folder, and the same graph as an SQL prefix for oracle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import build
from ..sources import fixture
from ..workers import reach


class Graph:
    """Lazily built frames of one data folder; every access is a plan, nothing is collected or cached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        reach(spark)

    def table(self, name: str) -> DataFrame:
        return fixture.table(self.spark, self.sf_dir, name)

    @property
    def nodes(self) -> DataFrame:
        return fixture.nodes(self.spark, self.sf_dir)

    @property
    def raw_edges(self) -> DataFrame:
        return fixture.raw_edges(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return build.build_edges(self.raw_edges, self.nodes)

    def relation(self, prop: int) -> DataFrame:
        """Edges of one relation: the filter reaches the raw branches, so the others aren't scanned."""
        return build.build_edges(self.raw_edges.where(f"prop = {prop}"), self.nodes)

    @property
    def statements(self) -> DataFrame:
        return fixture.statements(self.spark, self.sf_dir)

    @property
    def texts(self) -> DataFrame:
        return fixture.entity_texts(self.spark, self.sf_dir)


NODES = """nodes AS (
  SELECT CAST(1000 + r_regionkey AS BIGINT) AS qid, r_name AS label_en, 101 AS class_id FROM region
  UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), n_name, 102 FROM nation
  UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), c_name, 103 FROM customer
  UNION ALL SELECT CAST(20000000 + s_suppkey AS BIGINT), s_name, 104 FROM supplier
  UNION ALL SELECT CAST(30000000 + p_partkey AS BIGINT), p_name, 105 FROM part
  UNION ALL SELECT CAST(40000000 + o_orderkey AS BIGINT), concat('Order#', CAST(o_orderkey AS VARCHAR)), 106 FROM orders
  UNION ALL SELECT CAST(x AS BIGINT), y, 100 FROM (VALUES (101, 'region'), (102, 'nation'), (103, 'customer'), (104, 'supplier'), (105, 'part'), (106, 'order'), (100, 'class')) v(x, y)
)"""
RAW_EDGES = """raw_edges AS (
  SELECT CAST(2000 + n_nationkey AS BIGINT) AS src, 1 AS prop, CAST(1000 + n_regionkey AS BIGINT) AS dst FROM nation
  UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), 2, CAST(2000 + c_nationkey AS BIGINT) FROM customer
  UNION ALL SELECT CAST(20000000 + s_suppkey AS BIGINT), 3, CAST(2000 + s_nationkey AS BIGINT) FROM supplier
  UNION ALL SELECT CAST(40000000 + o_orderkey AS BIGINT), 4, CAST(10000000 + o_custkey AS BIGINT) FROM orders
  UNION ALL SELECT CAST(40000000 + l_orderkey AS BIGINT), 5, CAST(30000000 + l_partkey AS BIGINT) FROM lineitem
  UNION ALL SELECT CAST(40000000 + l_orderkey AS BIGINT), 6, CAST(20000000 + l_suppkey AS BIGINT) FROM lineitem
  UNION ALL SELECT CAST(30000000 + l_partkey AS BIGINT), 7, CAST(20000000 + l_suppkey AS BIGINT) FROM lineitem
  UNION ALL SELECT CAST(30000000 + p_partkey AS BIGINT), 9, CAST(30000001 + p_partkey AS BIGINT) FROM part
  UNION ALL SELECT CAST(30000000 + p_partkey AS BIGINT), 10, CAST(30000000 + floor(p_partkey / 2) AS BIGINT) FROM part
  UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), 11, CAST(10000001 + c_custkey AS BIGINT) FROM customer WHERE c_custkey % 10 <> 9
  UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), 12, CAST(2000 + (n_nationkey + 1) % 25 AS BIGINT) FROM nation
  UNION ALL SELECT CAST(2000 + (n_nationkey + 1) % 25 AS BIGINT), 12, CAST(2000 + n_nationkey AS BIGINT) FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), 13, CAST(2000 + c_nationkey AS BIGINT) FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT qid, 31, CAST(class_id AS BIGINT) FROM nodes
)"""
EDGES = "edges AS (SELECT DISTINCT src, prop, dst FROM raw_edges WHERE dst IN (SELECT qid FROM nodes))"
STATEMENTS = """statements AS (
  SELECT concat('S', l_orderkey, '-', l_linenumber) AS statement_id, 40000000 + l_orderkey AS subject, 5 AS prop, 30000000 + l_partkey AS value,
         CASE l_returnflag WHEN 'A' THEN 'preferred' WHEN 'R' THEN 'deprecated' ELSE 'normal' END AS rank,
         strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_quantity AS quantity, CASE WHEN l_linestatus = 'F' THEN concat('Q', 20000000 + l_suppkey) END AS source_id,
         row_number() OVER (ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS place
  FROM lineitem)"""
GRAPH = f"{NODES}, {RAW_EDGES}, {EDGES}"
