"""Entity records: claims with ranks and qualifiers, references, texts in several languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LANGUAGES


def ranked_claims(claims: DataFrame, place: str = "place") -> DataFrame:
    """subject, prop, value, rank: one row per (property, value) of a subject; its last rank wins, a missing one is normal."""
    return claims.groupBy("subject", "prop", "value").agg(F.coalesce(F.max_by("rank", place), F.lit("normal")).alias("rank"))


def best_rank(claims: DataFrame) -> DataFrame:
    """Per subject and property the preferred claims if there are any, else those that aren't deprecated."""
    group = Window.partitionBy("subject", "prop")
    preferred = F.max(F.col("rank") == "preferred").over(group)
    return claims.withColumn("_any", preferred).where(F.when(F.col("_any"), F.col("rank") == "preferred").otherwise(F.col("rank") != "deprecated")).drop("_any")


def with_qualifiers(claims: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """Adds the sorted list of qualifiers of the (property, value) pair: statements that share a pair share them, repeats stay."""
    lists = qualifiers.groupBy("subject", "prop", "value").agg(F.sort_array(F.collect_list(F.struct("qualifier", "qualifier_value"))).alias("qualifiers"))
    none = F.array().cast("array<struct<qualifier:string,qualifier_value:string>>")
    return claims.join(lists, ["subject", "prop", "value"], "left").withColumn("qualifiers", F.coalesce("qualifiers", none))


def references(rows: DataFrame) -> DataFrame:
    """subject, prop, value and its sorted distinct sources; unsourced statements don't appear."""
    return rows.where(F.col("source").isNotNull()).groupBy("subject", "prop", "value").agg(F.sort_array(F.collect_set(F.struct("source_prop", "source"))).alias("sources"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, sorted distinct relations of its outgoing edges, and their number."""
    props = edges.groupBy(F.col("src").alias("qid")).agg(F.sort_array(F.collect_set("prop")).alias("props"))
    return nodes.join(props, "qid", "left").withColumn("props", F.coalesce("props", F.array().cast("array<int>"))).withColumn("n_props", F.size("props"))


def in_language(field: str, language: str) -> Column:
    """One language, no fallback."""
    return F.col(f"{field}_{language}")


def with_fallback(field: str, language: str, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The asked language if its text isn't empty, else the first of the others, in their order, that has one."""
    return F.coalesce(*[F.nullif(F.col(f"{field}_{x}"), F.lit("")) for x in (language, *languages)])


def text_map(field: str, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """language -> text of those that have one."""
    whole = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.col(f"{field}_{lang}"))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def languages_of(fields: tuple[str, ...], languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Languages in which any of the fields has text."""
    def present(lang: str) -> Column:
        found = F.lit(False)
        for f in fields:
            found = found | (F.coalesce(F.col(f"{f}_{lang}"), F.lit("")) != "")
        return F.when(found, F.lit(lang))

    return F.array_compact(F.array(*[present(lang) for lang in languages]))


def describe(records: DataFrame, fields: tuple[str, ...], languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds ``languages``: language -> struct of fields, for languages where any field has text."""
    entries = [(lang, F.struct(*[F.col(f"{f}_{lang}").alias(f) for f in fields])) for lang in languages]
    whole = F.create_map(*[x for lang, s in entries for x in (F.lit(lang), s)])

    def held(_: Column, v: Column) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | (F.coalesce(v[f], F.lit("")) != "")
        return out

    return records.withColumn("languages", F.map_filter(whole, held))


def rare_flags(description: str = "description", rare: tuple[str, ...] = ("ar", "ru"), common: tuple[str, ...] = ("en", "fr", "de", "zh")) -> tuple[Column, Column]:
    """Whether any rare language has a description, and whether only rare ones do."""
    def any_of(langs: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for x in langs:
            out = out | (F.coalesce(F.col(f"{description}_{x}"), F.lit("")) != "")
        return out

    return any_of(rare), any_of(rare) & ~any_of(common)
