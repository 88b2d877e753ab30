"""Vaccination coverage per place and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.dates import shift_weeks, week_of
from ..functions.nulls import if_else, ratio
from .joins import natural_join

# Labels of the long vaccination table.
COUNTED = ["Partial", "Complete", "Booster"]
PARTIAL_LABELS = ["Partial", "Partial Coverage"]
PARTIAL_SHARE, COMPLETE_SHARE = "Partial Coverage", "Complete Coverage"


def _by_type(value: Column, partial: Column) -> list[Column]:
    """Two columns from one long column: cheaper than a pivot and with fixed names."""
    return [
        F.avg(F.when(partial, value)).alias("Partial"),
        F.avg(F.when(~partial, value)).alias("Complete"),
    ]


def vaccination_coverage(vax_long: DataFrame, until=None, geo: DataFrame | None = None) -> DataFrame:
    """Mean covered share of the population -> week, fips, Partial, Complete[, name, state].

    Counts are divided by the population, percentages by 100; shares above one are left out. A
    booster counts as complete.
    """
    share = F.when(F.col("CASE_TYPE").isin(*COUNTED), ratio(F.col("CASES"), F.col("POPN"))).otherwise(
        F.col("CASES") * 1e-2
    )
    rows = vax_long.filter(
        F.col("COUNTY").isNotNull() & F.col("CASE_TYPE").isNotNull() & (F.col("CASE_TYPE") != "NA") & F.col("DATE").isNotNull()
    )
    if until is not None:
        rows = rows.filter(F.col("DATE") < F.lit(until).cast("date"))
    rows = rows.select(
        week_of(F.col("DATE")).alias("week"),
        F.col("COUNTY").try_cast("int").alias("fips"),
        F.col("CASE_TYPE").isin(*PARTIAL_LABELS).alias("partial"),
        share.alias("share"),
    ).filter((F.col("share") <= 1) & F.col("fips").isNotNull())
    cover = rows.groupBy("week", "fips").agg(*_by_type(F.col("share"), F.col("partial")))
    return cover if geo is None else natural_join(cover, geo, ["fips"])


def partial_only(coverage: DataFrame) -> DataFrame:
    """Partial coverage without the people who went on to complete it."""
    return coverage.withColumn("Partial", F.col("Partial") - F.col("Complete"))


def coverage_lagged(vax_long: DataFrame, weeks: int = 2, units: dict | None = None) -> DataFrame:
    """Coverage from the percentage rows, delayed until it protects -> week, fips, complete, partial.

    Jointly reported counties are averaged into their unit. Partial coverage is raised to the
    complete one before the difference is taken.
    """
    mapping = {**places.RENAMED, **(places.MERGED if units is None else units)}
    rows = vax_long.filter(F.col("CASE_TYPE").isin(PARTIAL_SHARE, COMPLETE_SHARE))
    per_county = rows.groupBy(
        week_of(F.col("DATE")).alias("week"), F.col("COUNTY").try_cast("int").alias("fips")
    ).agg(*_by_type(F.col("CASES"), F.col("CASE_TYPE") == PARTIAL_SHARE))
    merged = (
        per_county.groupBy("week", places.recode(F.col("fips"), mapping).alias("fips"))
        .agg((F.avg("Complete") * 1e-2).alias("complete"), (F.avg("Partial") * 1e-2).alias("partial"))
    )
    at_least = if_else(F.col("complete") > F.col("partial"), F.col("complete"), F.col("partial"))
    return merged.select(
        shift_weeks(F.col("week"), weeks).alias("week"),
        "fips",
        "complete",
        (at_least - F.col("complete")).alias("partial"),
    )
