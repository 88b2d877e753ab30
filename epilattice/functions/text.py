"""String helpers for the record sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    """Column name in lower snake case: symbols and case changes become single underscores."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def piece(x: Column, sep: str, limit: int, k: int) -> Column:
    """Trimmed k-th piece of at most ``limit`` pieces; a missing piece is '' and not NULL."""
    parts = F.split(x, re.escape(sep), limit)
    return F.when(x.isNotNull(), F.trim(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))))


def words_from(x: Column, start: int) -> Column:
    """The words of a text from the ``start``-th to the last."""
    parts = F.split(x, " ")
    return F.array_join(F.slice(parts, start, F.greatest(F.size(parts), F.lit(1))), " ")


def parse_number(x: Column) -> Column:
    """First number inside a text, NULL where there is none."""
    found = F.regexp_extract(x, r"-?\d+(?:\.\d+)?", 0)
    return F.when(found != "", found).try_cast("double")


def pairs_of(x: Column, sep: str = ", ", value_sep: str = ": ") -> Column:
    """Map from a 'key: value, key: value' text."""
    return F.str_to_map(x, F.lit(re.escape(sep)), F.lit(re.escape(value_sep)))
