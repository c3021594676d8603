"""Sharding: minimum-cost-flow resharding.

From the sizes of the old shards and the capacities of the new ones, ``solve_flow``
finds the block transfers that move the fewest bytes; ``reshard`` gives every row
its new shard and slot, and ``rewrite`` writes only the shards whose rows change, whole
rows of the stored layout that ``write_layout`` made and ``stored`` reads.  The plan has
narrow rows; they meet the texts again by file and place in it, which no two rows share.

Old shards are ordered in blocks of hashed keys.  A flow from old shard *i* to new
shard *j* is an interval of *i*'s bytes in that order, so that an assignment needs
the sizes of blocks only, no global sort, and no row ever meets a whole shard in
one task.  A row belongs to the interval in which its first byte lies; a new shard
is off its capacity by less than one row per interval.

Defined results: a null text has size 1; rows that repeat an id are ordered by size
and checksum and get slots of their own; a null id hashes as the empty text; an
empty table gives no rows; columns besides id and text are left out.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, id_mod


def solve_flow(sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """Bytes sent from each old shard to each new one; staying under the same number is free, moving a byte costs 1.

    Successive shortest paths on source -> old -> new -> sink.  Costs are 0 or 1 and
    residual arcs may cost -1, so paths come from a queue-based Bellman-Ford.  The
    graph has a node per shard, never per row.
    """
    total = sum(sizes)
    if sum(capacities) < total:
        raise ValueError("capacities are below the total size")
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            arcs[x].append(len(head))
            head.append(y)
            room.append(c)
            cost.append(p)

    for i, s in enumerate(sizes):
        arc(source, i, s, 0)
    for j, c in enumerate(capacities):
        arc(n + j, sink, c, 0)
    first = len(head)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, total, int(i != j))
    sent = 0
    while sent < total:
        far = [1 << 60] * len(arcs)
        by = [-1] * len(arcs)
        far[source], queue, waiting = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in arcs[a]:
                if room[e] > 0 and far[a] + cost[e] < far[head[e]]:
                    far[head[e]], by[head[e]] = far[a] + cost[e], e
                    if head[e] not in waiting:
                        waiting.add(head[e])
                        queue.append(head[e])
        push, at = total - sent, sink
        while at != source:
            push, at = min(push, room[by[at]]), head[by[at] ^ 1]
        at = sink
        while at != source:
            room[by[at]] -= push
            room[by[at] ^ 1] += push
            at = head[by[at] ^ 1]
        sent += push
    return [[room[first + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def transfers(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old, first byte, end byte, new) intervals; the part that stays comes first."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def reshard(rows: DataFrame, shards: int, capacities: list[int] | None = None, block_rows: int = 2000) -> DataFrame:
    """``rows`` has key, old (int), size (long), and crc; adds shard (int) and slot (long, gapless from 0 in its shard).

    Shuffles: the narrow rows once by block; sizes of blocks and of their pieces are pre-aggregated tables.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "reshard")
    count = rows.count()
    blocks = max(1, count // block_rows)
    cut = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(blocks)).cast("long")
    rows = rows.withColumn("block", cut)
    sums = scratch.write(rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")))
    # one row per old shard, not per data row
    sizes = {r["old"]: r["bytes"] for r in sums.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    n_old = max(sizes, default=-1) + 1
    olds = [sizes.get(i, 0) for i in range(n_old)]
    flow = solve_flow(olds, capacities or equal_capacities(sum(olds), shards))
    plan = transfers(flow)

    starts = sums.withColumn("base", F.sum("bytes").over(Window.partitionBy("old").orderBy("block")) - F.col("bytes")).drop("bytes")
    within = Window.partitionBy("old", "block").orderBy("key", "size", "crc")
    placed = (
        rows.join(starts, ["old", "block"])
        .withColumn("at", F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("shard", _interval(plan))
        .withColumn("rank", F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("at")) - 1)
        .drop("base")
    )
    placed = scratch.write(placed)
    pieces = placed.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n"))
    bases = pieces.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).drop("n")
    return placed.join(bases, ["shard", "old", "block"]).withColumn("slot", (F.col("first") + F.col("rank")).cast("long")).drop("first", "rank", "block", "at")


def _interval(plan: list[tuple[int, int, int, int]]) -> Column:
    """The new shard of the byte ``at`` of shard ``old``; the plan has a few intervals per pair of shards."""
    by_old: dict[int, list[tuple[int, int]]] = {}
    for old, _, end, new in plan:
        by_old.setdefault(old, []).append((end, new))
    out = None
    for old, ends in by_old.items():
        inner = F.lit(ends[-1][1])
        for end, new in reversed(ends[:-1]):
            inner = F.when(F.col("at") < F.lit(end), F.lit(new)).otherwise(inner)
        out = F.when(F.col("old") == old, inner) if out is None else out.when(F.col("old") == old, inner)
    return (out if out is not None else F.lit(0)).cast("int")


def rewrite(spark: SparkSession, placed: DataFrame, path: str, version: int, texts: DataFrame | None = None) -> DataFrame:
    """Writes the shards that gain or lose rows under ``path/v<version>/shard=<n>``; returns a manifest (shard, moved_in, moved_out, version).

    A shard that keeps exactly its rows isn't written again: its manifest version is null, so its old files stay in use.
    ``texts`` (file, place, text) are the stored rows that ``placed``, then with file and place, was planned from.
    """
    moved = F.col("old") != F.col("shard")
    gains = placed.where(moved).groupBy("shard").agg(F.count(F.lit(1)).alias("moved_in"))
    losses = placed.where(moved).groupBy(F.col("old").alias("shard")).agg(F.count(F.lit(1)).alias("moved_out"))
    every = placed.select("shard").union(placed.select(F.col("old").alias("shard"))).distinct()
    manifest = every.join(gains, "shard", "left").join(losses, "shard", "left").na.fill(0, ["moved_in", "moved_out"])
    manifest = manifest.withColumn("version", F.when(F.col("moved_in") + F.col("moved_out") > 0, F.lit(version)))
    affected = manifest.where(F.col("version").isNotNull()).select("shard")
    rows = placed.join(F.broadcast(affected), "shard", "left_semi")
    if texts is None:
        rows = rows.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(16)))
    else:
        # texts move once, by their place; each task then writes a file of each shard it has rows of
        rows = texts.join(rows.select("file", "place", "key", "old", "shard", "slot"), ["file", "place"]).drop("file", "place")
    rows.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/v{version}")
    return manifest


def write_layout(docs: DataFrame, old_shards: int, path: str) -> None:
    """Writes the old layout, key and text, under ``path/v0/shard=<n>``; it deals by a checksum of the id."""
    shard = id_mod(F.col("doc_id"), old_shards).cast("int")
    docs.select(F.col("doc_id").alias("key"), "text", shard.alias("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/v0")


def stored(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    """file, place, key, text and old shard of every row of the old layout."""
    files = spark.read.schema(f"key {key_type}, text string, shard int").parquet(f"{path}/v0")
    return files.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "key", "text", F.col("shard").alias("old"))


def measured(rows: DataFrame) -> DataFrame:
    """Rows with size and crc of their text in its stead."""
    return rows.withColumn("size", text_size(F.col("text"))).withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).drop("text")


def read_layout(spark: SparkSession, path: str, version: int, manifest: DataFrame, placed: DataFrame, key_type: str) -> DataFrame:
    """key, text, old, shard and slot of every row, from the rewritten files and, for shards that kept their rows, the old ones."""
    fresh = spark.read.schema(f"key {key_type}, text string, old int, slot long, shard int").parquet(f"{path}/v{version}")
    out = fresh.select("key", "text", "old", "shard", "slot")
    kept = [r["shard"] for r in manifest.where("version is null").select("shard").collect()]  # a row per shard
    if kept:
        slots = placed.where(F.col("shard").isin(kept)).select("file", "place", "shard", "slot")
        out = out.union(stored(spark, path, key_type).where(F.col("old").isin(kept)).join(slots, ["file", "place"]).select("key", "text", "old", "shard", "slot"))
    return out


def from_documents(docs: DataFrame, old_shards: int) -> DataFrame:
    """key, old, size and crc of every text; the old layout deals by a checksum of the id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("key"), id_mod(F.col("doc_id"), old_shards).cast("int").alias("old"), text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
