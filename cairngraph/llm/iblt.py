"""Document fingerprints with DataFrame and SQL functions only: invertible Bloom lookup sketches of paragraphs.

A text is its set of paragraph digests: lines, those over 200 letters cut after sentence
ends and bars.  A sketch has three tables of cells; a digest goes to one cell of each and
adds 1 to its count and its bits to two XOR sums (digest and check).  Sketches subtract cell
by cell, so common paragraphs cancel; peeling then takes cells that hold one digest until
nothing is left, which recovers the paragraphs on which two texts differ.

A text of many paragraphs deals its digests into groups by their low bits, each with a
sketch of its own, and its fingerprint is all of them.  Two texts are compared on these
sketches, at the number of groups of the larger text (the smaller one's are built at that
number too, if it differs).  A group whose peeling leaves cells is sketched again with tables
twice as large, and so on until it peels.  Work grows with the number of paragraphs, times
its logarithm for the dealing.

Likeness is intersection over union of the digest sets, from their sizes and the number of
recovered differences; two texts without paragraphs are alike (1).

Defined results: null text is the empty text, whose fingerprint has empty cells only; equal texts have equal
fingerprints; repeated paragraphs count once; rows that repeat an id are ordered by a hash of
their text; a null id sorts below every other; an only document is its own successor; an empty
table gives no rows; only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of each of the three tables of a sketch, the most digests that a group holds on average, rounds of peeling, and doublings of the tables after which only digests that are equal in all hashes could be left.
TABLE, PER_GROUP, ROUNDS, DOUBLINGS = 12, 8, 12, 24
LINE = 200
#: Documents of a bucket of neighbours, the number of buckets from which both grow with the square root of the rows, and the most bounds that are searched.
BUCKET, BUCKETS, BOUNDS = 400, 1 << 14, 1 << 12

_EMPTY = "named_struct('n', 0, 'key', 0L, 'chk', 0L)"


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """SQL for the distinct 64-bit digests of a text's paragraphs."""
    cut = f"flatten(transform(split({text}, '\\n+'), p -> if(length(p) > {LINE}, split(p, '(?<=[.!?;|])\\\\s+'), array(p))))".replace("\n", "\\n")
    return f"array_distinct(transform(filter({cut}, p -> p RLIKE '\\\\S'), p -> xxhash64(p)))"


def levels(keys: str) -> str:
    """SQL for the number of low bits by which a text's digests are dealt."""
    return f"cast(ceil(log2(greatest(1.0D, size({keys}) / {PER_GROUP}.0D))) AS int)"


def groups(keys: str, bits: str) -> str:
    """SQL for the digests dealt by their low bits, one bit at a time."""
    return f"aggregate(slice(sequence(0, 62), 1, {bits}), array({keys}), (gs, l) -> flatten(transform(gs, q -> array(filter(q, x -> (shiftright(x, l) & 1L) = 0L), filter(q, x -> (shiftright(x, l) & 1L) = 1L)))))"


def _check(key: str) -> str:
    return f"shiftrightunsigned(xxhash64({key}, 17L), 32)"


def _placed(signed: str, table: str) -> str:
    """SQL for an array of (key, n), n being 1 or -1, with the check and the cell in each table; ``table`` is SQL for the cells of a table."""
    return f"transform({signed}, x -> named_struct('key', x.key, 'n', x.n, 'chk', {_check('x.key')}, 'p', cast(pmod(xxhash64(x.key, 1), {table}) AS int), 'q', cast(pmod(xxhash64(x.key, 2), {table}) AS int), 'r', cast(pmod(xxhash64(x.key, 3), {table}) AS int)))"


def sketch(keys: str, table: str = str(TABLE)) -> str:
    """SQL for the sketch of an array of digests."""
    # a cell that no digest goes to isn't worked out
    cell = lambda t: f"if(array_contains(at, i), aggregate(filter(en, x -> x.{t} = i), {_EMPTY}, (a, x) -> named_struct('n', a.n + x.n, 'key', a.key ^ x.key, 'chk', a.chk ^ x.chk)), {_EMPTY})"
    cells = lambda t: _bound(f"en.{t}", "at", f"transform(sequence(0, {table} - 1), i -> {cell(t)})")
    entries = _placed(f"transform({keys}, x -> named_struct('key', x, 'n', 1))", table)
    return _bound(entries, "en", f"named_struct('p', {cells('p')}, 'q', {cells('q')}, 'r', {cells('r')})")


def sketches(keys: str, bits: str) -> str:
    """SQL for the sketches of all groups of a text."""
    return f"transform({groups(keys, bits)}, g -> {sketch('g')})"


def line(held: str) -> str:
    """SQL for sketches as text: count, digest and check of each cell that isn't empty."""
    return f"array_join(transform(flatten(transform({held}, s -> concat(s.p, s.q, s.r))), c -> if(c.n = 0, '', concat(c.n, '.', hex(c.key), '.', hex(c.chk)))), ' ')"


def subtract(a: str, b: str) -> str:
    """SQL for the difference of two sketches of one size."""
    cells = lambda t: f"zip_with({a}.{t}, {b}.{t}, (c, d) -> named_struct('n', c.n - d.n, 'key', c.key ^ d.key, 'chk', c.chk ^ d.chk))"
    return f"named_struct('p', {cells('p')}, 'q', {cells('q')}, 'r', {cells('r')})"


_NONE = "cast(array() AS array<bigint>)"
_FAILED = f"named_struct('whole', false, 'plus', {_NONE}, 'minus', {_NONE})"


def peel(cells: str, table: str) -> str:
    """SQL for whole (no cell is left), and the digests of the first (plus) and the second text only (minus): each round takes all digests that stand alone in a cell out of the sketch."""
    pure = f"array_distinct(transform(filter(concat(st.cells.p, st.cells.q, st.cells.r), c -> (c.n = 1 OR c.n = -1) AND {_check('c.key')} = c.chk), c -> named_struct('key', c.key, 'n', c.n)))"
    side = lambda n: f"transform(filter(pk, u -> u.n = {n}), u -> u.key)"
    # only cells that one of them goes to change
    cell = lambda t: f"if(array_contains(at, i), aggregate(filter(pl, x -> x.{t} = i), c, (a, x) -> named_struct('n', a.n - x.n, 'key', a.key ^ x.key, 'chk', a.chk ^ x.chk)), c)"
    less = lambda t: _bound(f"pl.{t}", "at", f"transform(st.cells.{t}, (c, i) -> {cell(t)})")
    after = _bound(_placed("pk", table), "pl", f"named_struct('p', {less('p')}, 'q', {less('q')}, 'r', {less('r')})")
    step = _bound(pure, "pk", f"if(size(pk) = 0, named_struct('cells', st.cells, 'plus', st.plus, 'minus', st.minus, 'go', false), named_struct('cells', {after}, 'plus', concat(st.plus, {side('1')}), 'minus', concat(st.minus, {side('-1')}), 'go', true))")
    start = f"named_struct('cells', {cells}, 'plus', {_NONE}, 'minus', {_NONE}, 'go', true)"
    left = "exists(concat(st.cells.p, st.cells.q, st.cells.r), c -> c.n <> 0 OR c.key <> 0L OR c.chk <> 0L)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, _round) -> if(st.go, {step}, st), st -> named_struct('whole', NOT {left}, 'plus', st.plus, 'minus', st.minus))"


def differing(a: str, b: str, sketches_a: str, sketches_b: str, bits: str) -> str:
    """SQL for plus and minus, the digests in one of two sets only, from the sketches of both at ``bits`` levels; groups that don't peel are sketched again, larger each time."""
    first = _bound(subtract("ab.x", "ab.y"), "df", peel("df", str(TABLE)))
    size = f"shiftleft({TABLE}, doubled)"
    again = _bound(_bound(f"named_struct('x', {sketch('w.x', size)}, 'y', {sketch('w.y', size)})", "ab2", subtract("ab2.x", "ab2.y")), "df2", peel("df2", size))
    group = lambda keys: f"element_at({groups(keys, bits)}, i + 1)"
    larger = _bound(f"named_struct('x', {group(a)}, 'y', {group(b)})", "w", f"aggregate(sequence(1, {DOUBLINGS}), {_FAILED}, (o, doubled) -> if(o.whole, o, {again}))")
    each = f"transform(zip_with({sketches_a}, {sketches_b}, (x, y) -> named_struct('x', x, 'y', y)), (ab, i) -> {_bound(first, 'o1', f'if(o1.whole, o1, {larger})')})"
    return _bound(each, "os", "named_struct('plus', flatten(transform(os, o -> o.plus)), 'minus', flatten(transform(os, o -> o.minus)))")


def likeness(a: str, b: str, d: str) -> str:
    return f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE (size({a}) + size({b}) - size({d}.plus) - size({d}.minus)) / cast(size({a}) + size({b}) + size({d}.plus) + size({d}.minus) AS double) END"


def sketched(df: DataFrame, text: str, x: str) -> DataFrame:
    """Adds k<x>, l<x> and s<x>: the digests of a text, the levels by which they are dealt, and their sketches."""
    return df.withColumn(f"k{x}", F.expr(digests(text))).withColumn(f"l{x}", F.expr(levels(f"k{x}"))).withColumn(f"s{x}", F.expr(sketches(f"k{x}", f"l{x}")))


def with_next(docs: DataFrame, key: str, text: str, bucket: int = BUCKET) -> DataFrame:
    """key, text (null: empty) and next_text, the text of the next row by descending key (after the last comes the first), with the sketches of both (``a`` and ``n``).

    Rows meet in buckets of neighbouring keys: bounds from approximate quantiles, between which
    keys are cut evenly, and a key with more rows than a bucket is cut by the hashes of its texts.
    Each bucket also gets a copy of the row that follows its last; so texts are shuffled once, and
    no task sees all rows.  A text is sketched once, after that shuffle, for itself and for the row
    before it.  Buckets, and rows of one, grow with the square root of all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("place")).withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    n = max(1, min(count // bucket, max(BUCKETS, math.isqrt(count))))
    held = max(bucket, count // n)
    q = min(n, BOUNDS)
    bounds = sorted(set(int(x) for x in rows.approxQuantile("place", [i / q for i in range(1, q)], min(0.001, 0.2 / q)))) if q > 1 else []
    width = 1 << len(bounds).bit_length()
    top = (1 << 63) - 1
    padded = [-(1 << 63), *bounds, *[top] * (width - len(bounds))]
    table = "cast(split('" + ",".join(map(str, padded)) + "', ',') AS array<bigint>)"
    steps = ",".join(str(width >> i) for i in range(1, width.bit_length()))
    # element i + 1 is the bound below the rows of interval i
    search = f"aggregate(array({steps}), 0, (i, s) -> if(element_at({table}, i + s + 1) < place, i + s, i))" if width > 1 else "0"
    cuts = -(-n // max(1, q))
    low, high = f"cast(element_at({table}, part + 1) AS double)", f"cast(element_at({table}, part + 2) AS double)"
    within = f"cast(least({cuts - 1}, greatest(0, floor((cast(place AS double) - {low}) / greatest(1.0D, {high} - {low}) * {cuts}))) AS int)" if cuts > 1 else "0"
    rows = rows.withColumn("part", F.expr(search)).withColumn("cut", F.expr(within))
    # keys with more rows than a bucket: fewer than there are buckets
    hot = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * held).select("place", F.ceil(F.col("n") / held).cast("int").alias("splits"))
    rows = rows.join(F.broadcast(hot), "place", "left").withColumn("sub", F.when(F.col("splits").isNull(), 0).otherwise(F.floor((F.col("tie").cast("double") / F.lit(2.0**64) + 0.5) * F.col("splits")).cast("int"))).drop("splits")
    # a hot key is a bucket apart from its neighbours, which are above or below it
    at = ["part", "cut", "place_of", "sub"]
    alone = rows.join(F.broadcast(hot.select("place", F.lit(True).alias("hot"))), "place", "left")
    hots = sorted(r["place"] for r in hot.collect())
    above = F.lit(0)
    for p in hots:
        above = above + (F.col("place") > p).cast("int") + (F.col("place") >= p).cast("int")
    rows = alone.drop("hot").withColumn("place_of", above)
    # one row per bucket; the sequence runs from high places to low ones and, within a place, from low hashes to high ones
    first = rows.groupBy(*at).agg(F.max(F.struct("place", F.bitwise_not("tie").alias("tie"))).alias("m")).collect()
    if not first:
        return sketched(sketched(rows.select("key", "text", F.col("text").alias("next_text")), "text", "a"), "next_text", "n")
    order = sorted(first, key=lambda r: (-r["part"], -r["cut"], -r["place_of"], r["sub"]))
    ghosts = [(order[(i + 1) % len(order)]["m"]["place"], ~order[(i + 1) % len(order)]["m"]["tie"], *[r[c] for c in at]) for i, r in enumerate(order)]
    moved = spark.createDataFrame(ghosts, "place long, tie long, " + ", ".join(f"{c} int" for c in at))
    own = rows.select("place", "tie", "key", "text")
    copies = own.join(F.broadcast(moved), ["place", "tie"]).groupBy(*at, "place", "tie").agg(F.min("text").alias("text")).select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "text", "place", "tie", *at, F.lit(1).alias("copy"))
    both = rows.select("key", "text", "place", "tie", *at, F.lit(0).alias("copy")).union(copies)
    sequence = Window.partitionBy(*at).orderBy("copy", F.desc("place"), "tie")
    held = sketched(both.repartition(*at), "text", "a")
    led = held.withColumn("next", F.lead(F.struct("text", "ka", "la", "sa")).over(sequence)).where("copy = 0")
    return led.select("key", "text", "ka", "la", "sa", F.col("next.text").alias("next_text"), *[F.col(f"next.{x}a").alias(f"{x}n") for x in "kls"])


def edited(df: DataFrame) -> DataFrame:
    """Adds n_chars and edited: the last third of the text replaced by as many first letters of the next."""
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(substr(text, 1, cast(n_chars - n_chars div 3 AS int)), substr(next_text, 1, cast(n_chars div 3 AS int)))"))


def compare(df: DataFrame) -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints and both likenesses of rows of ``with_next`` with edited."""
    held = sketched(df, "edited", "e").withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited", "next_text")
    at = lambda x, y: f"if(l{x} >= l{y}, s{x}, {sketches(f'k{x}', f'l{y}')})"
    pair = lambda x, y: F.expr(differing(f"k{x}", f"k{y}", at(x, y), at(y, x), f"greatest(l{x}, l{y})"))
    counted = held.select("*", pair("a", "e").alias("de"), pair("a", "n").alias("dn"))
    return counted.select("key", "n_chars", "edited_sha256", F.expr(line("sa")).alias("fingerprint"), F.expr(line("se")).alias("edited_fingerprint"), F.expr(likeness("ka", "ke", "de")).alias("near_edited"), F.expr(likeness("ka", "kn", "dn")).alias("near_next"))
