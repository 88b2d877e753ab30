"""Operators on panels: tables with one row per entity and week (or day).

Windows here are partitioned by entity, so a partition is never longer than the calendar. Bring
raw records to this grain with a map-side combined aggregate first. Statistics over larger groups
(a state, a destination, everything) go through ``with_group_stats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..session import settle
from .joins import attach, natural_join, with_group_stats


def distinct_values(df: DataFrame, column: str) -> Column:
    """Sorted distinct values of a bounded column (weeks, a place list) as one array scalar."""
    return df.agg(F.array_sort(F.collect_set(column)).alias(column)).scalar()


def complete(
    df: DataFrame, entity: list[str], axis: str, within: list[str] | None = None
) -> DataFrame:
    """Dense panel: every entity gets a row for every value of a bounded axis that occurs.

    The table is stored first, so what it comes from is read once for its rows, its entities and its axis. With ``within``
    the axis values are those of the entity's own group.
    """
    df = settle(df, "panel")
    if within:
        axes = df.groupBy(*within).agg(F.collect_set(axis).alias(axis))
        entities = df.select(*dict.fromkeys([*within, *entity])).distinct()
        grid = natural_join(entities, axes, within).withColumn(axis, F.explode(axis))
        return natural_join(grid, df, [*dict.fromkeys([*within, *entity]), axis])
    grid = df.select(*entity).distinct().withColumn(axis, distinct_values(df, axis))
    return natural_join(grid.withColumn(axis, F.explode(axis)), df, [*entity, axis])


def calendar_of(df: DataFrame, column: str, name: str = "t") -> DataFrame:
    """The values of a bounded axis in order -> column, name (1, 2, ...)."""
    values = df.agg(F.array_sort(F.collect_set(column)).alias(column))
    return values.select(F.posexplode(column).alias(name, column)).select(column, (F.col(name) + 1).cast("int").alias(name))


def time_index(df: DataFrame, column: str, name: str = "t", calendar: DataFrame | None = None) -> DataFrame:
    """Number the values of a bounded axis 1, 2, ... in order; a missing value has no number.

    The numbers are those of ``calendar``'s values, or of the table's own, which is then stored and read twice.
    """
    if calendar is None:
        df = calendar = settle(df, "indexed")
    return natural_join(df, calendar_of(calendar, column, name), [column]).select(*df.columns, name)


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def lagged(column: str, by: list[str], order: list[str], steps: int = 1) -> Column:
    return F.lag(column, steps).over(_ordered(by, order))


def first_difference(column: str, by: list[str], order: list[str]) -> Column:
    return F.col(column) - lagged(column, by, order)


def filled_down(column: str, by: list[str], order: list[str]) -> Column:
    """Last known value up to this row."""
    frame = _ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(frame)


def filled_up(column: str, by: list[str], order: list[str]) -> Column:
    """Next known value from this row on."""
    frame = _ordered(by, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.first(column, ignorenulls=True).over(frame)


def filled_down_up(column: str, by: list[str], order: list[str]) -> Column:
    return F.coalesce(filled_down(column, by, order), filled_up(column, by, order))


def filled_up_down(column: str, by: list[str], order: list[str]) -> Column:
    return F.coalesce(filled_up(column, by, order), filled_down(column, by, order))


def fill_down(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    return df.withColumns({c: filled_down(c, by, order) for c in columns})


def rolling_mean(column: str, by: list[str], order: list[str], before: int, after: int) -> Column:
    """Mean over a row frame, NULL where the frame is cut off or holds a missing value."""
    frame = _ordered(by, order).rowsBetween(-before, after)
    return F.when(F.count(column).over(frame) == before + after + 1, F.avg(column).over(frame))


def keep_large_groups(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Rows of groups with more than a number of rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > more_than)
    return attach(df, sizes, keys, "inner").drop("__n")


def drop_null_duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Drop a missing value where its group has more than one row."""
    sized = with_group_stats(df, keys, __n=F.count(F.lit(1)))
    return sized.filter(~((F.col("__n") > 1) & F.col(value).isNull())).drop("__n")


def well_observed(df: DataFrame, entity: list[str], axis: str, share: float = 0.8) -> DataFrame:
    """Rows of entities seen on more than a share of all values of the axis."""
    total = df.agg(F.count_distinct(axis).alias("n")).scalar()
    seen = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n"))
    kept = seen.filter(F.col("__n") / total > share).drop("__n")
    return attach(df, kept, entity, "semi")


def z_score(df: DataFrame, value: str, by: list[str], name: str = "z") -> DataFrame:
    """Standardise a column within groups, leaving missing values out."""
    scored = with_group_stats(df, by, __mean=F.avg(value), __sd=F.stddev_samp(value))
    z = ratio(F.col(value) - F.col("__mean"), F.col("__sd"))
    return scored.withColumn(name, z).drop("__mean", "__sd")


def over_group_mean(df: DataFrame, value: str, by: list[str], name: str | None = None) -> DataFrame:
    """Divide a column by its group's mean."""
    scored = with_group_stats(df, by, __mean=F.avg(value))
    return scored.withColumn(name or value, ratio(F.col(value), F.col("__mean"))).drop("__mean")


def share_of_group(df: DataFrame, value: str, by: list[str], total: str, share: str) -> DataFrame:
    """Add a group total and each row's share of it."""
    scored = with_group_stats(df, by, **{total: F.sum(value)})
    return scored.withColumn(share, ratio(F.col(value), F.col(total)))


def impute_group_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Replace missing values by their group's mean."""
    scored = with_group_stats(df, by, __mean=F.avg(value))
    return scored.withColumn(value, F.coalesce(value, "__mean")).drop("__mean")


def one_entity(df: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """All rows of one entity, picked by a seeded hash (the same one on every run)."""
    picked = df.select(key).distinct().agg(
        F.min_by(key, F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).alias(key)
    )
    return df.filter(F.col(key) == picked.scalar())


def reference_calendar(df: DataFrame, key: str, reference, axis: str = "week", start=None) -> DataFrame:
    """The weeks present for a reference entity."""
    rows = df.filter(F.col(key) == reference)
    if start is not None:
        rows = rows.filter(F.col(axis) >= F.lit(start).cast("date"))
    return rows.select(axis).distinct()


def within_range(df: DataFrame, axis: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; pushed into the scan of a partitioned table."""
    if start is not None:
        df = df.filter(F.col(axis) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(axis) <= F.lit(end).cast("date"))
    return df


def correct_cells(df: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Overwrite single cells from a small table of (keys, column) corrections."""
    fixes = corrections.select(*keys, F.col(column).alias("__fix"))
    fixed = natural_join(df, fixes, keys).withColumn(column, F.coalesce("__fix", column))
    return fixed.drop("__fix")
