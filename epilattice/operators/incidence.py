"""Weekly incidence from reported case counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.dates import week_of
from ..functions.nulls import in_set, ratio, skip_sum
from .joins import natural_join
from .panel import complete, first_difference


def place_population(population: DataFrame, value: str = "pop") -> DataFrame:
    """Whole-number population per reporting unit; merged counties are added up first."""
    return (
        population.select(places.merged(F.col("fips")).alias("fips"), F.col(value).alias("pop"))
        .groupBy("fips")
        .agg(F.sum("pop").cast("long").alias("pop"))
    )


def _daily(cases_daily: DataFrame, excluded) -> DataFrame:
    """One row per place and day. Repeats of a day collapse to the largest cumulative count."""
    known = cases_daily.filter(F.col("fips").isNotNull() & ~in_set(F.col("fips"), excluded))
    return known.groupBy("fips", "date").agg(F.max("cases").alias("cases"))


def weekly_incidence(
    cases_daily: DataFrame,
    excluded=places.TERRITORIES,
    population: DataFrame | None = None,
    geo: DataFrame | None = None,
    per_capita: bool = False,
) -> DataFrame:
    """New cases per place and week from cumulative daily counts -> fips, week, cases[, pop, state].

    Daily steps are added up within the week before negative totals become zero, so corrections
    inside a week cancel out. The panel is dense: a week without reports counts zero.
    """
    daily = _daily(cases_daily, excluded)
    steps = daily.withColumn("new", first_difference("cases", ["fips"], ["date"]))
    weekly = steps.groupBy("fips", week_of(F.col("date")).alias("week")).agg(
        skip_sum(F.col("new")).cast("long").alias("cases")
    )
    weekly = complete(weekly, ["fips"], "week").withColumn(
        "cases", F.greatest(F.coalesce("cases", F.lit(0)), F.lit(0)).cast("long")
    )
    if population is not None:
        weekly = natural_join(weekly, place_population(population), ["fips"])
    if geo is not None:
        weekly = natural_join(weekly, geo.select("fips", "state"), ["fips"])
        weekly = weekly.withColumn("state", places.unit_state(F.col("fips"), F.col("state")))
    if per_capita:
        weekly = weekly.withColumn("mean_incidence", ratio(F.col("cases").cast("double"), F.col("pop")))
    return weekly


def weekly_incidence_from_mean(cases_daily: DataFrame, until=None, excluded=places.TERRITORIES) -> DataFrame:
    """New cases as the step between weekly means of the cumulative count -> fips, week, cases.

    Weeks without reports stay on the grid as missing, and count as zero together with the step
    that follows them.
    """
    known = cases_daily.filter(F.col("fips").isNotNull() & ~in_set(F.col("fips"), excluded))
    weekly = known.groupBy("fips", week_of(F.col("date")).alias("week")).agg(F.avg("cases").cast("long").alias("cases"))
    dense = complete(weekly, ["fips"], "week")
    if until is not None:
        dense = dense.filter(F.col("week") < F.lit(until).cast("date"))
    step = first_difference("cases", ["fips"], ["week"])
    return dense.withColumn("cases", F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)).cast("long"))


def weekly_sum(daily_new: DataFrame, members=None, value: str = "cases") -> DataFrame:
    """Weekly sum of daily new cases for a set of places, on a dense grid -> fips, week, cases."""
    rows = daily_new if members is None else daily_new.filter(in_set(F.col("fips"), members))
    weekly = rows.groupBy("fips", week_of(F.col("date")).alias("week")).agg(
        skip_sum(F.col(value)).cast("long").alias("cases")
    )
    return complete(weekly, ["fips"], "week")


def combine_reports(statewide: DataFrame, city: DataFrame) -> DataFrame:
    """Rows of both sources, equal rows once."""
    return natural_join(statewide, city, statewide.columns, "full")


def mean_cumulative(cases_daily: DataFrame, city: bool = True) -> DataFrame:
    """Whole-number weekly mean of the cumulative count -> week, fips, n_covid.

    City-wide reports come under a name; they take the code set for the city.
    """
    code = F.col("fips")
    if city and "county" in cases_daily.columns:
        code = places.city_report_code(F.col("county"), code)
    return cases_daily.groupBy(week_of(F.col("date")).alias("week"), code.alias("fips")).agg(
        F.avg("cases").cast("long").alias("n_covid")
    )


def city_panel(
    cases_daily: DataFrame,
    population: DataFrame,
    city: str = places.CITY_REPORT_NAME,
    city_code: int = places.CITY_REPORT_CODE,
    city_population: int = places.CITY_REPORT_POPULATION,
) -> DataFrame:
    """Weekly mean counts with the city-wide report marked and given its own population.

    -> week, fips, n_covid, city (1 for the city's report), pop.
    """
    is_city = F.coalesce(F.col("county") == city, F.lit(False)).cast("int")
    code = places.city_report_code(F.col("county"), F.col("fips"), city, city_code)
    weekly = cases_daily.groupBy(week_of(F.col("date")).alias("week"), code.alias("fips")).agg(
        F.avg("cases").cast("long").alias("n_covid"), F.max(is_city).alias("city")
    )
    sized = natural_join(weekly, population.select("fips", F.col("pop").cast("long").alias("pop")), ["fips"])
    return sized.withColumn("pop", F.when(F.col("city") == 1, F.lit(city_population).cast("long")).otherwise(F.col("pop")))
