"""Secret scans with DataFrame and SQL functions only.

Base patterns find assignments, access keys and long hexadecimal runs.  Beside them,
every run of 20 or more token letters outside them is scored by two first-order Markov models
of characters, one of random strings and one of ordinary identifiers, trained from labelled
samples; each stretch of a run whose log-likelihood ratio exceeds a level is a span of its own.

Positions come from the pieces between matches: ``split`` by the same pattern gives their
lengths, and running sums over chunks of matches give starts, so a text with very many
matches costs little more than its length.

Defined results: null text is the empty text, which has no spans; an empty table gives no
rows; equal texts get equal spans; only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base kinds, and the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LETTERS, ACCESS_LETTERS = 12, 18
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models judge, the level in nats that they must exceed, and matches summed at a time.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
LEVEL = 12.0
#: The shortest stretch of a run that is a span, spans or matches summed at a time, and letters of the pieces that texts are cut in.
LEAST, CHUNK, PIECE = 20, 256, 1024
#: Documents that give ordinary words, and generated random strings, for training.
ORDINARY_DOCUMENTS, RANDOM_STRINGS = 400, 3000


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _holds(pattern: str) -> str:
    return f"text RLIKE '{_quoted(pattern)}'"


def _positions(text: str, pattern: str, quick: str, group: int = 0) -> str:
    """SQL for array<struct<s, e, t>> of all matches: code points from 0, end exclusive, and the text of the group; empty unless ``quick`` holds."""
    p = _quoted(pattern)
    pieces = f"transform(split({text}, '{p}', -1), x -> length(x))"
    found = f"regexp_extract_all({text}, '{p}', 0)"
    parts = f"regexp_extract_all({text}, '{p}', {group})"
    zipped = f"transform(arrays_zip({pieces}, {found}, {parts}), x -> named_struct('r', x.`0`, 'f', coalesce(length(x.`1`), 0), 't', x.`2`))"
    # bound once by a one-element array: chunks of matches, then the sums of chunks
    chunks = f"transform(sequence(0, (size(z) - 1) div {CHUNK}), i -> slice(z, i * {CHUNK} + 1, {CHUNK}))"
    sums = "transform(c, k -> aggregate(k, 0, (a, x) -> a + x.r + x.f))"
    none = "cast(array() AS array<struct<s:int,e:int,t:string>>)"
    walk = f"""aggregate(k, named_struct('at', aggregate(slice(s, 1, i), 0, (a, x) -> a + x), 'out', {none}),
        (a, x) -> named_struct('at', a.at + x.r + x.f, 'out', concat(a.out, array(named_struct('s', a.at + x.r, 'e', a.at + x.r + x.f, 't', x.t)))), a -> a.out)"""
    whole = f"flatten(transform(array({zipped}), z -> flatten(transform(array({chunks}), c -> flatten(transform(array({sums}), s -> flatten(transform(c, (k, i) -> {walk}))))))))"
    # the piece after the last match has no match
    return f"(CASE WHEN {quick} THEN filter({whole}, x -> x.t IS NOT NULL) ELSE {none} END)"


def _spans(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def random_strings(df: DataFrame) -> DataFrame:
    """(sample, label 1) for each row of ``range``: base64, base62-like and mixed-case keys of a hash."""
    raw = "unhex(sha2(cast(id AS string), 256))"
    return df.selectExpr(f"CASE id % 3 WHEN 0 THEN substr(base64({raw}), 1, 40) WHEN 1 THEN substr(regexp_replace(base64({raw}), '[+/=]', ''), 1, 32) ELSE substr(translate(base64({raw}), '+/', '-_'), 1, 43) END AS sample", "1 AS label")


def ordinary_words(docs: DataFrame, key: str, text: str, documents: int = ORDINARY_DOCUMENTS) -> DataFrame:
    """(sample, label 0): words of about ``documents`` texts, those of the least hashes of their keys, outside base spans."""
    share = min(1.0, documents / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), ASSIGN, " "), ACCESS, " "), HEX, " ")
    return picked.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("sample"), F.lit(0).alias("label"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the 128 x 128 pairs of ASCII characters; samples: sample, label (1: random, 0: ordinary).

    Only counts of pairs come to the driver: at most 2 x 128 x 128 rows.
    """
    codes = samples.selectExpr("label", "transform(split(sample, ''), x -> least(ascii(x), 127)) AS c")
    pairs = codes.selectExpr("label", "explode(zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> a * 128 + b)) AS pair")
    counts = {0: [0.0] * 16384, 1: [0.0] * 16384}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = float(r["count"])
    letters = [i for i in range(128) if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-")]

    # each row leans on the model's own frequencies of second characters, as rare first characters say little
    def logs(c: list[float]) -> dict[tuple[int, int], float]:
        total = sum(c[a * 128 + b] for a in letters for b in letters)
        second = {b: (sum(c[a * 128 + b] for a in letters) + 0.5) / (total + 0.5 * len(letters)) for b in letters}
        weight = 20.0
        return {(a, b): math.log((c[a * 128 + b] + weight * second[b]) / (sum(c[a * 128 + x] for x in letters) + weight)) for a in letters for b in letters}

    ratio = [0.0] * 16384
    one, zero = logs(counts[1]), logs(counts[0])
    for a, b in one:
        ratio[a * 128 + b] = max(-6.0, min(6.0, one[a, b] - zero[a, b]))
    return ratio


def _ratios(run: str, table: str) -> str:
    """SQL for the log-likelihood ratios of a run's pairs of characters."""
    return f"element_at(transform(array(transform(split({run}, ''), c -> ascii(c))), q -> zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (a, b) -> element_at({table}, a * 128 + b + 1))), 1)"


def _stretches(run: str, table: str, level: float) -> str:
    """SQL for array<struct<s, e>>, the stretches of a run that random strings explain better by more than ``level`` nats.

    A stretch begins where the sum of ratios leaves 0, ends at the sum's peak, and is over when the
    sum falls to 0 or by the level below the peak; so what stands beside a random string doesn't hide it.
    """
    none = "cast(array() AS array<struct<s:int,e:int>>)"
    held = f"if(a.peak > {level}D AND a.e - a.s >= {LEAST}, concat(a.out, array(named_struct('s', a.s, 'e', a.e))), a.out)"
    over = f"named_struct('i', a.i + 1, 's', a.i + 1, 'e', a.i + 1, 'now', 0D, 'peak', 0D, 'out', {held})"
    on = "named_struct('i', a.i + 1, 's', a.s, 'e', if(a.now + x > a.peak, a.i + 2, a.e), 'now', a.now + x, 'peak', greatest(a.peak, a.now + x), 'out', a.out)"
    return f"aggregate({_ratios(run, table)}, named_struct('i', 0, 's', 0, 'e', 0, 'now', 0D, 'peak', 0D, 'out', {none}), (a, x) -> if(a.now + x <= 0D OR a.now + x < a.peak - {level}D, {over}, {on}), a -> {held})"


def _reached(spans: str) -> str:
    """SQL: sorted spans with p, the furthest end of the spans before each; sums run over chunks, so the cost is about linear."""
    chunks = f"transform(sequence(0, (size(z) - 1) div {CHUNK}), i -> slice(z, i * {CHUNK} + 1, {CHUNK}))"
    none = "cast(array() AS array<struct<s:int,e:int,p:int>>)"
    walk = f"""aggregate(k, named_struct('at', aggregate(slice(m, 1, i), 0, (a, x) -> greatest(a, x)), 'out', {none}),
        (a, x) -> named_struct('at', greatest(a.at, x.e), 'out', concat(a.out, array(named_struct('s', x.s, 'e', x.e, 'p', a.at)))), a -> a.out)"""
    return f"flatten(transform(array({spans}), z -> flatten(transform(array({chunks}), c -> flatten(transform(array(transform(c, k -> array_max(transform(k, x -> x.e)))), m -> flatten(transform(c, (k, i) -> {walk}))))))))"


def _spliced(text: str, spans: str, filler: str) -> str:
    """SQL for the text in which each span's own part gives way to ``filler`` (SQL over x: s, e, p); letters are cut from pieces of the text, so that a far span costs no more than a near one."""
    piece = lambda low, high: f"if({high} <= {low}, '', substr(array_join(slice(ts, {low} div {PIECE} + 1, ({high} - 1) div {PIECE} - {low} div {PIECE} + 1), ''), {low} % {PIECE} + 1, {high} - {low}))"
    body = f"array_join(transform(rs, x -> concat({piece('x.p', 'x.s')}, {filler})), '')"
    end = "array_max(transform(rs, x -> x.e))"
    tail = f"element_at(transform(array({end}), z -> {piece('z', 'n')}), 1)"
    whole = f"element_at(transform(array({_reached(spans)}), rs -> element_at(transform(array(regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)), ts -> element_at(transform(array(length({text})), n -> concat({body}, {tail})), 1)), 1)), 1)"
    return f"if(size({spans}) = 0, {text}, {whole})"


def find(df: DataFrame, text: str, ratio: list[float], level: float = LEVEL) -> DataFrame:
    """row (a struct of all columns of df), text (null: empty), one array per base kind, and base and spans:
    sorted array<struct<s, k, e>>, k indexing KINDS; base leaves out what the models add."""
    table = "cast(split('" + ",".join(f"{x:.4f}" for x in ratio) + "', ',') AS array<double>)"
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("assign", F.expr(f"filter({_positions('text', ASSIGN, _holds(ASSIGN), 2)}, x -> length(x.t) >= {ASSIGN_LETTERS})"))
    access = _positions("text", ACCESS, "contains(text, 'AKIA')")
    rows = rows.withColumn("access", F.expr(f"filter({access}, x -> length(x.t) >= {ACCESS_LETTERS})"))
    rows = rows.withColumn("hex", F.expr(_positions("text", HEX, _holds(HEX))))
    rows = rows.withColumn("base", F.array_sort(F.concat(_spans(F.col("assign"), "assign"), _spans(F.col("access"), "access"), _spans(F.col("hex"), "hex"))))
    # base spans become as many spaces, so that the models judge what is left of a run beside them
    rows = rows.withColumn("masked", F.expr(_spliced("text", "base", "repeat(' ', greatest(0, x.e - greatest(x.s, x.p)))")))
    runs = _positions("masked", RUN, f"masked RLIKE '{_quoted(RUN)}'")
    rows = rows.withColumn("added", F.expr(f"flatten(transform({runs}, r -> transform({_stretches('r.t', table, level)}, x -> named_struct('s', r.s + x.s, 'e', r.s + x.e))))"))
    return rows.withColumn("spans", F.array_sort(F.concat("base", _spans(F.col("added"), "random")))).drop("masked", "added")


def line(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by one mark; the columns' names are given, and ``spans`` is sorted."""
    return F.expr(_spliced(text, spans, f"if(x.s >= x.p, '{_quoted(mark)}', '')"))
