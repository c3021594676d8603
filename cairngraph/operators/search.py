"""Full-text search over postings, property search, and hints for empty searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_tier, terms
from ..schema import BM25_B, BM25_K1, DEGREE_WEIGHT, LANGUAGES, SEARCH_DEPTH, SITELINK_WEIGHT


def query_words(text: str, spark) -> list[str]:
    """Words of a query, as the index cuts them; operators of a query language have no meaning here."""
    return spark.range(1).select(F.array_distinct(terms(F.lit(text)))).first()[0]


def bm25(postings: DataFrame, queries: DataFrame, n_docs: int, lengths: DataFrame) -> DataFrame:
    """query, qid and score of documents that hold all words of a query, in any field.

    queries: query, words (array).  lengths: field, avg_dl.  A word's score is that of its best field;
    the number of distinct words found is counted in the same aggregation as the scores.
    """
    words = queries.select("query", F.size("words").alias("wanted"), F.explode("words").alias("term"))
    hits = postings.join(words, "term").join(F.broadcast(lengths), "field")
    df = postings.join(words.select("term").distinct(), "term", "left_semi").groupBy("field", "term").agg(F.countDistinct("qid").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avg_dl")))
    scored = hits.join(df, ["field", "term"]).withColumn("s", idf * tf)
    best = scored.groupBy("query", "wanted", "qid", "term").agg(F.max("s").alias("s"))
    return best.groupBy("query", "wanted", "qid").agg(F.count(F.lit(1)).alias("found"), F.sum("s").alias("score")).where("found = wanted").select("query", "qid", "score")


def notability(score: Column, sitelinks: Column, degree: Column) -> Column:
    """Text score weighted by how widely documented and how connected an entity is."""
    return score * (1 + SITELINK_WEIGHT * sitelinks + DEGREE_WEIGHT * F.log1p(degree))


def search_entity(postings: DataFrame, notable: DataFrame, queries: DataFrame, n_docs: int, lengths: DataFrame, limit: int = 10, depth: int | None = SEARCH_DEPTH) -> DataFrame:
    """query, total, place, qid, score: the best ``depth`` by text (None: all), re-ranked by notability, cut at ``limit`` (both are the operator's feature)."""
    from pyspark.sql import Window

    found = bm25(postings, queries, n_docs, lengths)
    total = found.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    by = lambda c: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(c), "qid"))
    deep = found if depth is None else found.withColumn("_p", by(F.round("score", 9))).where(F.col("_p") <= depth).drop("_p")
    weighted = deep.join(notable, "qid").withColumn("score", F.round(notability(F.col("score"), F.col("sitelinks"), F.col("degree")), 6))
    return weighted.withColumn("place", by("score")).where(F.col("place") <= limit).join(total, "query").select("query", "total", "place", "qid", "score")


def search_property(labels: DataFrame, key: str, limit: int = 10, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """pid, label, language, tier, total: each property's best tier (the first language wins ties), by (tier, pid); an empty key finds nothing.

    labels: pid (int), language, label.
    """
    key = key.strip().lower()
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))
    tier = match_tier(F.lower("label"), F.lit(key)) if key else F.lit(None).cast("int")
    rows = labels.withColumn("tier", tier).where("tier is not null")
    best = rows.groupBy("pid").agg(F.min(F.struct("tier", place.alias("p"), "language", "label")).alias("b"))
    total = best.agg(F.count(F.lit(1)).alias("total"))
    return best.select("pid", "b.label", "b.language", "b.tier").join(F.broadcast(total)).orderBy("tier", "pid").limit(max(1, limit))


def hints(postings: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """query, word, n: how many documents each of the first ``most`` words of a query matches; a word with 0 is dead."""
    words = queries.select("query", F.posexplode("words").alias("pos", "term")).where(F.col("pos") < most)
    df = postings.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.countDistinct("qid").alias("n"))
    return words.join(df, "term", "left").select("query", F.col("term").alias("word"), F.coalesce("n", F.lit(0)).alias("n"))
