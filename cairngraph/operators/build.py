"""Building the graph: statements to edges, nodes, entity texts, records and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import item_number, property_number
from ..functions.text import fold, terms
from ..schema import LANGUAGES
from .spread import parts, spread


def first_statement_rows(statements: DataFrame, place: str = "place") -> DataFrame:
    """The first row of each statement id, by a pre-aggregated minimum (no window, no sort of a hot statement)."""
    return first_rows(statements, ["statement_id"], [place]).drop(place)


def first_rows(rows: DataFrame, key: list[str], place: list[str], tasks: int = 1) -> DataFrame:
    """The first row of each key by the columns of ``place``, dealt to ``tasks`` tasks: rows are sorted for the minimum after the shuffle alone, not before it too."""
    rest = [c for c in rows.columns if c not in (*key, *place)]
    return spread(rows, tasks, *key).groupBy(*key).agg(F.min(F.struct(*place, *rest)).alias("r")).select(*key, "r.*")


def item_claims(statements: DataFrame) -> DataFrame:
    """Statements with parsed ids and flags: ``claim`` links two items; ``bad_value`` and ``property_subject`` count the rejects."""
    s, v = item_number(F.col("subject_id")), item_number(F.col("value_id"))
    linked = F.col("value_type") == "wikibase-entityid"
    return statements.withColumns(
        {"src": s, "prop": property_number(F.col("property_id")), "dst": v, "claim": linked & (s >= 0) & (v >= 0), "bad_value": linked & (s >= 0) & (v < 0), "property_subject": F.coalesce(F.startswith("subject_id", F.lit("P")), F.lit(False))}
    )


def first_labels(statements: DataFrame, place: str = "place") -> DataFrame:
    """Label of each subject: that of its first row, for subjects that are items."""
    rows = statements.withColumn("qid", item_number(F.col("subject_id"))).where("qid >= 0")
    return rows.groupBy("qid").agg(F.min_by("subject_label", place).alias("label"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node.

    Most nodes point to their class, so a few targets hold a great part of the edges: these are streamed past a hash
    table of the nodes, of which each task has its part, as a sort would hold all edges of such a target in one task.
    """
    return edges.join(nodes.select(F.col("qid").alias("dst")).hint("shuffle_hash"), "dst", "left_semi").select("src", "prop", "dst")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "prop", "dst"])


def build_edges(raw: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """The stored edges; ``tasks`` is needed where ``raw`` is a join, whose size isn't told by its plan."""
    # distinct first, so that the semi join shuffles no repeats; dealt by both ends, which no hub makes uneven
    return inside(distinct_edges(spread(raw, tasks or parts(raw), "src", "dst")), nodes)


def write_edges(edges: DataFrame, name: str, key: str = "src", buckets: int = 200) -> None:
    """A table bucketed and sorted by one end, so that joins on it need no shuffle; write it once per direction."""
    order = ["src", "dst", "prop"] if key == "src" else ["dst", "src", "prop"]
    edges.write.bucketBy(buckets, key).sortBy(*order).mode("overwrite").saveAsTable(name)


def degrees(edges: DataFrame) -> DataFrame:
    """qid, deg_out, deg_in over all stored edges, self loops included."""
    end = lambda c, o, i: F.struct(F.col(c).alias("qid"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    # both ends of an edge in one pass; a union would build the edges twice
    ends = edges.select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("x")).select("x.*")
    return ends.groupBy("qid").agg(F.sum("o").alias("deg_out"), F.sum("i").alias("deg_in"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "qid", "left").na.fill(0, ["deg_out", "deg_in"])


def build_counters(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: raw edges, those beyond the boundary, repeats, and edges kept."""
    grouped = raw.groupBy("src", "prop", "dst").count()
    marked = grouped.join(nodes.select(F.col("qid").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    known = F.col("known").isNotNull()
    return marked.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("raw"), F.coalesce(F.sum(F.when(~known, F.col("count"))), F.lit(0)).alias("boundary_dropped"), F.coalesce(F.sum(F.when(known, F.col("count") - 1)), F.lit(0)).alias("repeats_dropped"), F.count_if(known).alias("kept")
    )


def pivot_texts(texts: DataFrame, key: str, languages: tuple[str, ...] = LANGUAGES, fields: tuple[str, ...] = ("description",), order: Column | None = None) -> DataFrame:
    """Long (key, language, fields) to one row per key with a column per field and language; of repeated rows the last by ``order`` wins.

    A conditional aggregate per column: languages are filtered at the scan and the pivot needs one shuffle.
    """
    order = F.col("place") if order is None else order
    rows = texts.where(F.col("language").isin(*languages))
    return rows.groupBy(key).agg(*[F.max_by(F.when(F.col("language") == lang, F.col(f)), F.when(F.col("language") == lang, order)).alias(f"{f}_{lang}") for f in fields for lang in languages])


def sitelink_count(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def property_labels(rows: DataFrame, place: str = "place") -> DataFrame:
    """First label that isn't null of each property."""
    return rows.where(F.col("property_label").isNotNull()).groupBy("property_id").agg(F.min_by("property_label", place).alias("label"))


def instance_lists(rows: DataFrame, nodes: DataFrame, place: str = "place") -> DataFrame:
    """Types of each node in arrival order, repeats kept, empty when none."""
    lists = rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "instance_of"))), lambda x: x["instance_of"]).alias("instance_of"))
    return nodes.join(lists, "qid", "left").withColumn("instance_of", F.coalesce("instance_of", F.array().cast("array<string>")))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Repeated keys with their counts; an empty result is the guard's pass."""
    return df.groupBy(key).count().where("count > 1")


def entity_records(nodes: DataFrame, claims: DataFrame, qualifiers: DataFrame, references: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per node with arrays of claim, qualifier, reference and rank structs (null when a node has none).

    Each side is aggregated on qid before it is joined on qid, so the four joins share one partitioning.
    """
    def lists(df: DataFrame, name: str, distinct: bool) -> DataFrame:
        columns = [c for c in df.columns if c != "qid"]
        gathered = F.collect_set(F.struct(*columns)) if distinct else F.collect_list(F.struct(*columns))
        return df.groupBy("qid").agg(F.sort_array(gathered).alias(name))

    out = nodes
    for df, name, distinct in ((claims, "claims", True), (qualifiers, "qualifiers", False), (references, "references", True), (ranks, "ranks", False)):
        out = out.join(lists(df, name, distinct), "qid", "left")
    return out


def range_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows in disjoint key ranges, with the part number; written with partitionBy, a lookup prunes to one part."""
    return df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())


def describe_parts(df: DataFrame, key: str, part: str = "part") -> DataFrame:
    """Inclusive bounds, rows, and whether a part overlaps the one before it.

    The overlap test looks at one row per part.
    """
    bounds = df.groupBy(part).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))
    return bounds.withColumn("overlaps", F.coalesce(F.col("low") <= F.lag("high").over(Window.orderBy("low", part)), F.lit(False)))


def search_documents(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """qid and one array of terms per text field, plus the diacritic-folded ``fold`` field; nodes without any text are left out."""
    words = {f: terms(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    every = F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    kept = nodes.where(F.trim(every) != "")
    return kept.select("*", *[w.alias(f"terms_{f}") for f, w in words.items()], terms(fold(every)).alias("terms_fold"))


def postings(documents: DataFrame, fields: list[str]) -> DataFrame:
    """qid, field, term, tf and dl (terms of the field)."""
    long = documents.select("qid", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"terms_{f}").alias("terms")) for f in fields])).alias("x"))
    rows = long.select("qid", "x.field", F.size("x.terms").alias("dl"), F.explode("x.terms").alias("term"))
    return rows.groupBy("qid", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
