"""Identifier codecs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = re.compile(r"Q[0-9]+")


def item_number(column: Column) -> Column:
    """``Q42`` to 42; anything that isn't Q and digits to -1 (a stripped P15 must not look like Q15)."""
    return F.coalesce(F.when(column.rlike("^Q[0-9]{1,18}$"), F.substr(column, F.lit(2)).cast("long")), F.lit(-1).cast("long"))


def property_number(column: Column) -> Column:
    """``P31`` to 31, else null."""
    return F.when(column.rlike("^P[0-9]+$"), F.substr(column, F.lit(2)).cast("int"))


def item_id(column: Column) -> Column:
    return F.concat(F.lit("Q"), column.cast("string"))


def parse_item(value: str | int) -> int:
    """Client-side codec: integers pass, ``Q42`` parses, the rest raises KeyError."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(value, str) and ITEM.fullmatch(value):
        return int(value[1:])
    raise KeyError(value)
