"""Vectors, batched judging by an injected callable, and the bounded scout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RANK_TOP, SCOUT_FLOOR, SCOUT_READS


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / length)


def centroid(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Mean of unit vectors per group, scaled back to unit length: dimensions are averaged before anything is gathered."""
    flat = df.select(*group, F.posexplode(vector).alias("i", "x")).groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = flat.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return lists.select(*group, normalized(F.col("v")).alias("centroid"))


def rank(vectors: DataFrame, query: Column | list[float], key: str = "vec_id", vector: str = "embedding", top: int = RANK_TOP) -> DataFrame:
    """The ``top`` nearest by cosine, rounded to 4; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    return vectors.select(key, F.round(dot(F.col(vector), q), 4).alias("score")).orderBy(F.desc("score"), key).limit(top)


def embed(texts: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """text, vector of every distinct text; texts in ``cache`` (text, vector) aren't encoded again, and vectors have unit length."""
    wanted = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    fresh = wanted.join(cache.select("text"), "text", "left_anti") if cache is not None else wanted

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = list(f["text"][at : at + batch])
                yield pd.DataFrame({"text": part, "vector": [[float(x) for x in v] for v in encoder(part)]})

    encoded = fresh.mapInPandas(run, "text string, vector array<double>").withColumn("vector", normalized(F.col("vector")))
    return encoded.union(cache.join(wanted, "text", "left_semi").select("text", "vector")) if cache is not None else encoded


def map_over(items: DataFrame, key: str, text: str, model: Callable[[str, list[tuple[str, str]]], str], instruction: str, batch: int = 10) -> DataFrame:
    """key, answer of every item: batches go to the model, which returns KEY<tab>ANSWER lines; a key without a line gets NO ANSWER.

    Batches are runs of rows within a partition, so no global numbering is needed.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                reply = model(instruction, list(zip(part["key"], part["text"].fillna(""), strict=True)))
                said = dict((a.strip(), b.strip()) for a, t, b in (line.partition("\t") for line in reply.splitlines()) if t)
                yield pd.DataFrame({"key": part["key"], "answer": [said.get(k, "NO ANSWER") for k in part["key"]]})

    return items.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, answer string")


def gradient(frontier: DataFrame, goal: list[float]) -> DataFrame:
    """One row: largest and median cosine of a frontier's vectors to the goal, rounded to 3."""
    cos = dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in goal]))
    return frontier.select(cos.alias("c")).agg(F.round(F.max("c"), 3).alias("largest"), F.round(F.median("c"), 3).alias("median"))


def scout(a: int, b: int, edges: DataFrame, vectors: DataFrame, max_reads: int = SCOUT_READS, floor: float = SCOUT_FLOOR) -> dict:
    """Searches a path between two nodes by expanding frontiers towards each other.

    Both ends are expanded (2 reads); if the frontiers meet, that is the path.  Else the best cosine between one
    frontier and the other end must reach ``floor``, and the most promising node of the smaller frontier is expanded
    next, until the frontiers meet or the reads are used.  vectors: qid, embedding.  Frontiers are held on the driver:
    they are at most ``max_reads`` adjacency pages.
    """
    known = edges.where("src <> dst")

    def expand(q: int) -> list[int]:
        rows = known.where((F.col("src") == q) | (F.col("dst") == q)).select(F.when(F.col("src") == q, F.col("dst")).otherwise(F.col("src")).alias("o")).distinct().orderBy("o").limit(200).collect()
        return [r["o"] for r in rows]

    def likeness(ids: list[int], goal: int) -> list[tuple[float, int]]:
        end = vectors.where(F.col("qid") == goal).select("embedding").first()
        if end is None or not ids:
            return []
        cos = F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in end[0]])), 4)
        return [(r["c"], r["qid"]) for r in vectors.where(F.col("qid").isin(*ids)).select("qid", cos.alias("c")).orderBy(F.desc("c"), "qid").collect()]

    sides = [({a: None}, [a], b), ({b: None}, [b], a)]  # parents, open nodes, goal
    reads, done = 0, set()

    def read(side: int, q: int) -> None:
        nonlocal reads
        reads += 1
        done.add(q)
        parents, todo, _ = sides[side]
        for o in expand(q):
            if o not in parents:
                parents[o] = q
                todo.append(o)

    def path(side: int, q: int) -> list[int]:
        out = [q]
        while sides[side][0][out[-1]] is not None:
            out.append(sides[side][0][out[-1]])
        return out

    read(0, a), read(1, b)
    while True:
        met = sorted(set(sides[0][0]) & set(sides[1][0]))
        if met:
            return {"status": "bridge", "path": path(0, met[0])[::-1] + path(1, met[0])[1:], "reads": reads}
        ranked = [likeness([q for q in todo if q not in done], goal) for _, todo, goal in sides]
        best = max((r[0][0] for r in ranked if r), default=None)
        if best is None or best < floor:
            return {"status": "no gradient", "gradient": best, "reads": reads}
        if reads >= max_reads:
            return {"status": "max reads", "gradient": best, "reads": reads}
        order = sorted((0, 1), key=lambda s: (not ranked[s], len(sides[s][1]), s))
        read(order[0], ranked[order[0]][0][1])
