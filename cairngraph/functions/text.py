"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Letters of two Latin blocks that decompose to one ASCII letter, and those that become several."""
    one, to, many = "", "", {}
    for code in [*range(0x00C0, 0x0180), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one, to = one + letter, to + plain
        elif plain:
            many[letter] = plain
    many["ß"] = "ss"
    return one, to, many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_table()


def fold(column: Column) -> Column:
    """Strips diacritics; letters without a decomposition stay."""
    out = F.translate(column, FOLD_FROM, FOLD_TO)
    for letter, plain in FOLD_MANY.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


#: Curly quotes, dashes and no-break spaces, and what they become (fixed values).
TYPOGRAPHIC_FROM = "’‘ʼ“”„–—−\u00a0\u202f\u2009"
TYPOGRAPHIC_TO = "'''\"\"\"---   "


def typographic(column: Column) -> Column:
    return F.translate(column, TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO)


def collapse(column: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def match_tier(label: Column, key: Column) -> Column:
    """0 equal, 1 prefix, 2 inside, else null; both sides lower-cased by the caller."""
    return F.when(label == key, 0).when(F.startswith(label, key), 1).when(F.contains(label, key), 2)


def terms(column: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def identifiers(column: Column) -> Column:
    """Item and property ids that stand alone."""
    return F.regexp_extract_all(column, F.lit(r"(?<![A-Za-z0-9])([QP]\d+)(?![A-Za-z0-9])"), F.lit(1))


def code_blocks(column: Column) -> Column:
    """Bodies of fenced blocks without a language, or marked python or repl."""
    return F.regexp_extract_all(column, F.lit(r"(?s)```(?:python|repl)?[ \t]*\n(.*?)```"), F.lit(1))


def strip_fence(column: Column) -> Column:
    """A fenced JSON answer without its fences."""
    return F.trim(F.regexp_replace(F.trim(column), r"(?s)^```[a-z]*\s*\n?|\n?```$", ""))


def tail(column: Column, letters: int = 10_000) -> Column:
    return F.right(column, F.lit(letters))


def task_pattern(task: Column) -> Column:
    return F.split_part(task, F.lit("_"), F.lit(1))


def task_of_run(run: Column) -> Column:
    """A run's name without its time stamp and number."""
    return F.regexp_replace(run, r"_\d{8}_\d{6}_\d+$", "")
