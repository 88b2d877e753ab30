"""Set operations and changes of shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pairs_of, parse_number


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return stack(*frames).distinct()


def widen(df: DataFrame, keys: list[str], names: str, values: str, levels: list) -> DataFrame:
    """One column per level. The levels are given, so no extra pass looks for them."""
    return df.groupBy(*keys).pivot(names, levels).agg(F.first(values, ignorenulls=True))


def lengthen(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def nest(panel: DataFrame, keys: list[str], columns: list[str], into: str = "data") -> DataFrame:
    """One row per entity with its rows as a sorted array; for panels, whose rows per entity are bounded."""
    return panel.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias(into)
    )


def unnest(df: DataFrame, column: str = "data") -> DataFrame:
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.inline(column))


def explode_pairs(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row per entry of a 'key: number, key: number' text."""
    kept = [F.col(c) for c in df.columns if c != column]
    entries = df.select(*kept, F.explode(pairs_of(F.col(column))).alias("__k", "__v"))
    return entries.select(
        *kept, parse_number(F.col("__k")).cast("int").alias(key), parse_number(F.col("__v")).alias(value)
    )


def index_of(variable: Column, k: int) -> Column:
    """k-th index of a name such as ``mult[3,12]``."""
    found = F.regexp_extract(variable, r"\[(\d+)(?:,(\d+))?\]", k)
    return F.when(found != "", found).try_cast("int")


def stem_of(variable: Column) -> Column:
    return F.split(variable, r"\[", 2)[0]
