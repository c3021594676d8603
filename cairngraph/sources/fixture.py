"""The star schema read as a property graph: nodes, raw edges, statements and entity texts.

Identities are offset per table (regions 1000, nations 2000, customers 10,000,000, suppliers
20,000,000, parts 30,000,000, orders 40,000,000; classes 100 to 106).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = 1000, 2000, 10_000_000, 20_000_000, 30_000_000, 40_000_000
CLASSES = {101: "region", 102: "nation", 103: "customer", 104: "supplier", 105: "part", 106: "order"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(column: str, base: int) -> Column:
    return (F.col(column) + F.lit(base)).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, label_en, class_id."""
    named = [("region", "r_regionkey", REGION, F.col("r_name"), 101), ("nation", "n_nationkey", NATION, F.col("n_name"), 102), ("customer", "c_custkey", CUSTOMER, F.col("c_name"), 103)]
    named += [("supplier", "s_suppkey", SUPPLIER, F.col("s_name"), 104), ("part", "p_partkey", PART, F.col("p_name"), 105)]
    named += [("orders", "o_orderkey", ORDER, F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), 106)]
    parts = [table(spark, sf_dir, t).select(_id(k, base).alias("qid"), label.alias("label_en"), F.lit(c).alias("class_id")) for t, k, base, label, c in named]
    # values in the plan, whose size Spark knows (that of a local list counts as unlimited)
    classes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}L, '{v}', 100)" for k, v in [*CLASSES.items(), (100, "class")]) + " AS v(qid, label_en, class_id)")
    return reduce(DataFrame.union, [*parts, classes])


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, prop, dst before deduplication and the boundary filter."""
    nation, customer, supplier, part, orders, lineitem = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"))

    def rel(df: DataFrame, src: Column, prop: int, dst: Column) -> DataFrame:
        return df.select(src.cast("long").alias("src"), F.lit(prop).alias("prop"), dst.cast("long").alias("dst"))

    following = F.lit(NATION) + (F.col("n_nationkey") + 1) % 25
    kinds = [
        rel(nation, _id("n_nationkey", NATION), 1, _id("n_regionkey", REGION)),
        rel(customer, _id("c_custkey", CUSTOMER), 2, _id("c_nationkey", NATION)),
        rel(supplier, _id("s_suppkey", SUPPLIER), 3, _id("s_nationkey", NATION)),
        rel(orders, _id("o_orderkey", ORDER), 4, _id("o_custkey", CUSTOMER)),
        rel(lineitem, _id("l_orderkey", ORDER), 5, _id("l_partkey", PART)),
        rel(lineitem, _id("l_orderkey", ORDER), 6, _id("l_suppkey", SUPPLIER)),
        rel(lineitem, _id("l_partkey", PART), 7, _id("l_suppkey", SUPPLIER)),
        rel(part, _id("p_partkey", PART), 9, _id("p_partkey", PART + 1)),
        rel(part, _id("p_partkey", PART), 10, F.floor(F.col("p_partkey") / 2) + PART),
        rel(customer.where("c_custkey % 10 <> 9"), _id("c_custkey", CUSTOMER), 11, _id("c_custkey", CUSTOMER + 1)),
        rel(nation, _id("n_nationkey", NATION), 12, following),
        rel(nation.where("n_nationkey % 2 = 0"), following, 12, _id("n_nationkey", NATION)),
        rel(customer.where("c_acctbal >= 0"), _id("c_custkey", CUSTOMER), 13, _id("c_nationkey", NATION)),
        nodes(spark, sf_dir).select(F.col("qid").alias("src"), F.lit(31).alias("prop"), F.col("class_id").cast("long").alias("dst")),
    ]
    return reduce(DataFrame.union, kinds)


#: What names a statement, and what orders the rows of one.
LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_PLACE = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as statements in raw form (string ids), several rows per statement id; ``place`` orders them."""
    return as_statements(table(spark, sf_dir, "lineitem"))


def as_statements(line: DataFrame) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "A", "preferred").when(F.col("l_returnflag") == "R", "deprecated").otherwise("normal")
    place = F.struct(*LINE_PLACE)
    return line.select(
        F.concat(F.lit("S"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("statement_id"),
        F.concat(F.lit("Q"), _id("l_orderkey", ORDER)).alias("subject_id"), F.lit("P5").alias("property_id"), F.concat(F.lit("Q"), _id("l_partkey", PART)).alias("value_id"), F.lit("wikibase-entityid").alias("value_type"), rank.alias("rank"),
        place.alias("place"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Q"), _id("l_suppkey", SUPPLIER))).alias("source_id"),
    )


def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, language, description and doc_id: a source of documents is an entity, a text of it a description."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("entity"), F.col("lang").alias("language"), F.col("text").alias("description"), "doc_id")
