"""Joins on shared column names, with missing keys matching missing keys.

``natural_join`` is for panels and dimensions, whose keys are unique on at least one side.
``attach`` is for the one-row-per-key side of a group statistic or lookup going onto a large table
whose keys may be very uneven: the large side is salted, so one hot key is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pieces a hot key is cut into. After salting both join inputs come straight from a shuffle, which
# is also what AQE needs to cut an oversized partition further.
SALTS = 16

# Types whose values are the same whenever a task is run again. A sum of doubles is not: its last bit follows the order
# in which shuffle blocks arrive, and a row whose salt changed would go to another task than before.
EXACT = (T.IntegralType, T.DateType, T.TimestampType, T.StringType, T.BooleanType, T.DecimalType)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _aside(right: DataFrame, keys: list[str]) -> DataFrame:
    """Rename the keys of one side so that both can be compared without ambiguity."""
    return right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])


def _matched(keys: list[str], null_safe: bool) -> Column:
    pairs = [(F.col(k), F.col(f"__r_{k}")) for k in keys]
    return _all([a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(
    left: DataFrame, right: DataFrame, expect: list[str], how: str = "left", null_safe: bool = True
) -> DataFrame:
    """Join on all shared column names, which must be exactly ``expect``.

    ``how`` is left, inner, full, semi or anti. A full join gives each key once.
    """
    keys = shared_columns(left, right)
    if set(keys) != set(expect) or not keys:
        raise ValueError(f"the tables share {sorted(keys)}, expected {sorted(expect)}")
    other = _aside(right, keys)
    condition = _matched(keys, null_safe)
    if how in ("semi", "anti"):
        return left.join(other.select([f"__r_{k}" for k in keys]), condition, f"left_{how}")
    joined = left.join(other, condition, {"full": "full_outer"}.get(how, how))
    own = [
        F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if how == "full" and c in keys else F.col(c)
        for c in left.columns
    ]
    return joined.select(*own, *[F.col(c) for c in right.columns if c not in keys])


def attach(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Salted natural join of a per-key table onto a large table with uneven keys.

    The salt is a hash of the row's exact columns besides the key, so a hot key is spread over many tasks, and a task
    that is run again computes the same salts. Any salt finds the same partner, as each row of ``right`` is present
    under every salt. Without such a column, or with ``salts=1``, it is a plain join, which Spark may split when it
    finds a partition much larger than the others.
    """
    varied = [f.name for f in left.schema.fields if f.name not in keys and isinstance(f.dataType, EXACT)]
    if not varied or salts == 1:
        return natural_join(left, right, keys, how)
    row = F.xxhash64(*[F.col(c) for c in varied])
    big = left.withColumn("__salt", F.pmod(row, F.lit(salts)).cast("int"))
    small = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return natural_join(big, small, [*keys, "__salt"], how).drop("__salt")


def with_group_stats(df: DataFrame, keys: list[str], salts: int = SALTS, **stats: Column) -> DataFrame:
    """Add statistics of a row's group to the row.

    Two steps instead of a window: a map-side combined aggregate, then ``attach``. A window would
    bring a whole group into one task.
    """
    if not keys:
        return with_scalars(df, **stats)
    groups = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return attach(df, groups, keys, "left", salts)


def with_scalars(df: DataFrame, **stats: Column) -> DataFrame:
    """Add statistics of the whole table to each row, as scalar subqueries."""
    for name, c in stats.items():
        df = df.withColumn(name, df.agg(c.alias(name)).scalar())
    return df


def keep_members(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose code is in the one-column table ``members``."""
    return attach(df, members.toDF(column), [column], "semi")


def drop_members(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows whose code is not in ``members``; a missing code stays unless it is listed itself."""
    return natural_join(df, members.toDF(column), [column], "anti")


def lookup_two_roles(
    edges: DataFrame, values: DataFrame, key: str, first: str, second: str, by: list[str] | None = None
) -> DataFrame:
    """Join one table twice, once for each endpoint of an edge."""
    by = by or []
    measures = [c for c in values.columns if c != key and c not in by]
    for role in (first, second):
        named = values.select(
            F.col(key).alias(role), *by, *[F.col(c).alias(f"{c}_{role}") for c in measures]
        )
        edges = attach(edges, named, [role, *by])
    return edges


def group_positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Number the rows of each entity by an explicit order (panel rows only)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def positional_join(
    left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]
) -> DataFrame:
    """Pair the n-th row of each entity on the left with its n-th row on the right.

    Both sides are panels: the rows per entity are bounded by the calendar.
    """
    a = group_positions(left, by, left_order, "__position")
    b = group_positions(right, by, right_order, "__position")
    return natural_join(a, b, [*by, "__position"]).drop("__position")


def version_diff(
    old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-3
) -> DataFrame:
    """Rows of two versions of a table that differ by more than a tolerance."""
    a = old.select(*keys, F.col(value).alias("old"))
    b = new.select(*keys, F.col(value).alias("new"))
    return (
        natural_join(a, b, keys, "full")
        .withColumn("difference", F.col("old") - F.col("new"))
        .filter(F.abs(F.col("difference")) > tolerance)
    )
