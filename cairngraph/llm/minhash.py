"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

1. Every text becomes its set of hashed word shingles, the minima of many universal
   hashes, a key per band of minima and one byte per minimum (the signature).
2. Texts with the same set are one class; classes meet in band buckets.
3. In every bucket the members pair with its smallest class only.  Each class verifies
   its most alike centre on full sets, and components of these links follow; then the
   pairs of member and centre that still lie in two components are verified.
4. Buckets that still hold several components compare the rest: their members are classed
   by size, so that only neighbouring classes can link, and dealt, with their sets, into
   parts of bounded size; parts meet in blocks that a worker takes one at a time, and pairs
   of different components whose signatures pass are verified inside the block, each pair in
   the first bucket that it shares; only links come out, at most one per member and
   component.  So no link that a bucket holds is lost, no bucket gathers in a task, and no
   pairs are emitted.
5. Components come from alternating large-star and small-star rounds, on edges contracted
   by the components known so far.

With 32 bands of 5, a pair at similarity 0.8 misses all buckets with probability 3e-6;
the signature test passes 3.5 standard deviations below the threshold.  The texts to
verify are picked by a bitmap of hashed ids of fixed size, so the corpus isn't shuffled.

Defined results: null or blank text has an empty set and links with nothing; with fewer
words than a shingle the whole sequence is one shingle; equal sets share a class, so
repeated rows and repeated ids land in one component; rows without an id are left out of
links and keep a null component; an empty table gives no rows; input columns other than
id and text are ignored, so their names can't clash; ids may be any 64-bit numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, dealt_join, small_batches
from .shingles import MinHash, shingle_set

BANDS, ROWS, MINIMA = 32, 5, 384
#: Members, and set hashes, of one part of a bucket in the exhaustive step.
BLOCK, BLOCK_HASHES = 1024, 800_000
#: Bits of the bitmap of hashed ids: 8 MB, whatever the data.
BITS, BUCKET_BITS = 1 << 26, 1 << 15


def _features(docs: DataFrame, words: int) -> DataFrame:
    """id, n, two sums that identify the set, band keys and signature of every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        hashing = MinHash(BANDS, ROWS, MINIMA)
        for batch in batches:
            n, s1, s2, keys, signatures = [], [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), words)
                n.append(len(h))
                if not len(h):
                    s1.append(0), s2.append(0), keys.append([]), signatures.append(b"")
                    continue
                m = hashing.minima(h)
                s1.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(h * (h >> np.uint64(32) | np.uint64(1))).view(np.int64)))
                keys.append(hashing.keys(m))
                signatures.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["id", "n", "s1", "s2", "keys", "sig"]
            )

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>, sig binary")


def _place() -> Column:
    """The bit of an id."""
    return F.pmod(F.xxhash64("id"), F.lit(BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids: BITS / BUCKET_BITS rows of 4 KB at most come to the driver."""
    parts = ids.select(_place().alias("p")).groupBy(F.floor(F.col("p") / BUCKET_BITS).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(p % {BUCKET_BITS})").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():
        at = int(r["bucket"]) * BUCKET_BITS // 8
        out[at : at + BUCKET_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and the sorted set hashes, 8 bytes each, of the documents whose id is in the bitmap of ``ids`` (and of few others)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def run(batches):
        bits = shared.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], ["id", "hashes"])

    # an id that repeats with other texts links by any of them
    return docs.select("id", "text", _place().alias("place")).mapInArrow(run, "id long, hashes binary")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The distinct pairs (a, b) with 100 * intersection >= threshold * union on full sets."""

    def run(batches):
        for batch in batches:
            keep, last, x = [], None, None
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                raw = left.as_py()
                if raw != last:
                    last, x = raw, np.frombuffer(raw, np.uint64)
                keep.append(_linked(x, np.frombuffer(right.as_py(), np.uint64), threshold))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(docs, ids, words)
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    # each member is in few pairs, a centre can be in very many
    both = dealt_join(pairs.select("a", "b").join(right, "b"), left, "a", "b", pairs)
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _least_agreement(threshold: int) -> int:
    t = threshold / 100
    return int(MINIMA * t - 3.5 * (MINIMA * t * (1 - t)) ** 0.5)


def _star_pairs(keys: DataFrame, centres: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """(a: centre, b: member, alike) for members whose sizes and signatures allow the threshold."""
    least = _least_agreement(threshold)
    pairs = keys.join(centres.where("members > 1"), "key").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, MINIMA)
            y = np.frombuffer(b"".join(batch.column("y").to_pylist()), np.uint8).reshape(-1, MINIMA)
            same = (x == y).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int32())], ["a", "b", "alike"])
            yield out.filter(pa.array(same >= least))

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("x"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, alike int")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets of hashes reach the threshold."""
    at = np.searchsorted(x, y)
    same = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return 100 * same >= threshold * (len(x) + len(y) - same)


def _size_class(threshold: int) -> Column:
    """Sets that can reach the threshold are in the same class of sizes or in neighbouring ones (classes are a little wider than the threshold, for rounding)."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / threshold) * (1 + 1e-9))).cast("int") if threshold < 100 else F.lit(0)


def _mixed(owned: DataFrame, threshold: int) -> DataFrame:
    """key and parts (size class -> number of parts) of the buckets of three or more members that hold several components; owned: c_id, n, keys."""
    spread = owned.select("c_id", "n", _size_class(threshold).alias("class"), F.explode("keys").alias("key"))
    classes = spread.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashed"), F.min("c_id").alias("lo"), F.max("c_id").alias("hi"))
    parts = F.struct("class", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("hashed") / BLOCK_HASHES)).cast("int").alias("parts"))
    # a bucket has at most as many classes as there are orders of size
    buckets = classes.groupBy("key").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(parts)).alias("parts"))
    return buckets.where("m > 2 and lo <> hi").select("key", "parts")


def _block_links(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between different components, a spanning part of them per block; members: band, key, parts, id, component, n, sig, keys, hashes."""
    least = _least_agreement(threshold)
    placed = members.withColumn("class", _size_class(threshold)).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts[class]) AS int)"))
    # a block is two parts of a class, or a part of a class and one of the next; a row is on side 0, 1, or both (2)
    own = "transform(sequence(0, parts[class] - 1), o -> named_struct('c', class, 'd', class, 'i', least(part, o), 'j', greatest(part, o), 'side', if(o = part, 2, if(part < o, 0, 1))))"
    up = "if(parts[class + 1] IS NULL, array(), transform(sequence(0, coalesce(parts[class + 1], 1) - 1), o -> named_struct('c', class, 'd', class + 1, 'i', part, 'j', o, 'side', 0)))"
    down = "if(parts[class - 1] IS NULL, array(), transform(sequence(0, coalesce(parts[class - 1], 1) - 1), o -> named_struct('c', class - 1, 'd', class, 'i', o, 'j', part, 'side', 1)))"
    block = ["key", "c", "d", "i", "j"]
    dealt = placed.withColumn("blocks", F.expr(f"concat({own}, {up}, {down})")).select("key", "band", "id", "component", "n", "sig", "keys", "hashes", F.explode("blocks").alias("x")).select("key", "x.*", "band", "id", "component", "n", "sig", "keys", "hashes")
    sorted_rows = dealt.repartition(*block).sortWithinPartitions(*block)

    def run(batches):
        held, at = [], None

        def links():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a, b = _compared(rows, threshold, least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(c).to_pylist() for c in block), strict=True))
            cuts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]
            for low, high in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if held and marks[low] != at:
                    yield links()
                    held = []
                held.append(batch.slice(low, high - low))
                at = marks[low]
        if held:
            yield links()

    return sorted_rows.mapInArrow(run, "a long, b long")


def _compared(rows: pa.RecordBatch, threshold: int, least: int) -> tuple[list[int], list[int]]:
    """Links between the two sides of one block."""
    a, b = [], []
    ids, comp, n, side = (rows.column(c).to_numpy() for c in ("id", "component", "n", "side"))
    if (comp == comp[0]).all():
        return a, b
    band = rows.column("band")[0].as_py()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
    keys = rows.column("keys").flatten().to_numpy().reshape(len(ids), -1)
    hashes = rows.column("hashes")
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for r in first:
        k = second[(comp[second] != comp[r]) & (100 * np.minimum(n[second], n[r]) >= threshold * np.maximum(n[second], n[r]))]
        k = k[(side[k] != 2) | (ids[k] > ids[r])]
        # only where this band is the first that the two share
        k = k[(keys[k] == keys[r]).argmax(axis=1) == band]
        alike = (sig[k] == sig[r]).sum(axis=1)
        k = k[np.argsort(-alike, kind="stable")][: int((alike >= least).sum())]  # likeliest first
        x = np.frombuffer(hashes[int(r)].as_py(), np.uint64) if len(k) else None
        for o in k.tolist():
            p, s = find(int(comp[r])), find(int(comp[o]))
            if p != s and _linked(x, np.frombuffer(hashes[o].as_py(), np.uint64), threshold):
                root[max(p, s)] = min(p, s)
                a.append(int(ids[r])), b.append(int(ids[o]))
    return a, b


def _named(ids: DataFrame, comp: DataFrame, name: str) -> DataFrame:
    """ids with c_<name>, the component of the id in column ``name`` (itself if it has none)."""
    held = comp.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    return ids.join(held, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))


def _merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links: their ends become components, which are joined, and every node follows its component.  ``comp`` is dropped."""
    ends = _named(_named(links, comp, "a"), comp, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    joined = components(ends, scratch)
    more = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = comp.join(more, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # components that were single classes are nodes of the new links only
    out = scratch.write(old.union(more.select(F.col("component").alias("node"), F.col("to").alias("component"))).distinct())
    scratch.drop(comp, joined)
    return out


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: int = 80) -> DataFrame:
    """id, n_shingles, class_id (smallest id with the same set) and component_id of every row; see the module's docstring."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    base = scratch.write(_features(docs, words))
    full = base.where("n > 0 and id is not null")
    # one class per set; copies are aggregated before they are shuffled
    classes = full.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "keys", "sig")).alias("r"))
    reps = scratch.write(classes.select("n", "s1", "s2", "r.id", "r.keys", "r.sig"))
    rows = base.drop("keys", "sig")
    texts = docs.where("id is not null")

    keys = reps.select("id", F.explode("keys").alias("key"))
    centres = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members"))
    stars = scratch.write(_star_pairs(keys, centres, reps, threshold))
    best = scratch.write(stars.groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a").cast("decimal(20,0)"))).alias("a")).select("a", "b"))
    links = scratch.write(_verified(best, texts, words, threshold))
    comp = components(links, scratch)

    rest = _named(_named(stars.select("a", "b"), comp, "a"), comp, "b").where("c_a <> c_b").select("a", "b").join(best, ["a", "b"], "left_anti")
    tested = scratch.write(rest)
    scratch.drop(stars, best, links)
    links = scratch.write(_verified(tested, texts, words, threshold))
    comp = _merged(comp, links, scratch)
    scratch.drop(tested, links)

    owned = _named(reps.select("id", "n", "sig", "keys"), comp, "id")
    found = scratch.write(owned.select("id", F.posexplode("keys").alias("band", "key")).join(_mixed(owned, threshold), "key"))
    sets = _sets(texts, found.select("id").distinct(), words)
    members = found.join(owned.select("id", F.col("c_id").alias("component"), "n", "sig", "keys"), "id").join(sets, "id")
    links = scratch.write(_block_links(members, threshold))
    comp = _merged(comp, links, scratch)
    scratch.drop(found, links)

    named = _named(reps.select("n", "s1", "s2", "id"), comp, "id").withColumnsRenamed({"id": "class_id", "c_id": "component"})
    out = rows.join(named, ["n", "s1", "s2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: int = 80) -> DataFrame:
    """docs without near duplicates: the smallest id of each component stays, once (of rows that repeat it, the least text); rows without an id stay.

    Rows go through as one struct, so columns of any name stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, words, threshold)
    dropped = found.where("id <> component_id").select(F.col("id").alias("key")).distinct()
    rows = docs.select(F.col(id_col).alias("key"), F.struct("*").alias("row"))
    kept = rows.join(dropped, "key", "left_anti")
    if not rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").isEmpty():
        # the least text of a key, and of equal ones the least hash of the row, by a pre-aggregated minimum
        text = F.col("row").getField(text_col)
        least = F.struct(text.isNull().alias("none"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64("row").alias("hash"))
        single = kept.where("key IS NOT NULL").groupBy("key").agg(F.min_by("row", least).alias("row"))
        kept = single.union(kept.where("key IS NULL"))
    return kept.select("row.*")
