"""Serosurveys: preparation, smoothing and poststratification to places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.dates import parse_month_day_year, week_of
from ..functions.nulls import in_set, ratio, sentinel_to_null, skip_sum, strict_sum, weighted_mean
from ..functions.stats import se_from_interval
from ..functions.text import words_from
from .incidence import mean_cumulative
from .joins import natural_join, with_group_stats
from .panel import complete, filled_up_down, time_index
from .smoothing import binomial_smooth

# Codes of the survey for a rate that was not published.
NO_RATE = (666, 777)

# Column names of the published survey.
SURVEY_COLUMNS = {
    "Site": "state",
    "Date Range of Specimen Collection": "range",
    "Rate (%) [Cumulative Prevalence]": "rate",
    "Estimated cumulative infections count": "mean_sero",
    "Estimated cumulative infections upper CI": "upper",
    "Estimated cumulative infections lower CI": "lower",
    "n [Cumulative Prevalence]": "n",
    "Catchment population": "pop",
}


def serosurvey_prepare(serosurvey: DataFrame) -> DataFrame:
    """State-by-week survey panel -> state, week, rate, n, mean_sero, upper, lower, pop, se, t, success.

    The week is that of the last day of the collection range. The grid is dense over states and
    weeks; the population of a state is filled from its other rounds.
    """
    rows = serosurvey.select([F.col(f"`{old}`").alias(new) for old, new in SURVEY_COLUMNS.items()])
    last_day = parse_month_day_year(words_from(F.col("range"), 4))
    rows = rows.withColumn("week", week_of(last_day)).drop("range")
    rows = rows.withColumn("rate", sentinel_to_null(F.col("rate"), *NO_RATE) * 1e-2)
    dense = time_index(complete(rows, ["state"], "week"), "week", "t", calendar=rows)
    return dense.withColumns(
        {
            "se": se_from_interval(F.col("lower"), F.col("upper")),
            "success": (F.col("rate") * F.col("n")).cast("long"),
            "pop": filled_up_down("pop", ["state"], ["week"]),
        }
    )


def basis_sizes(prepared: DataFrame, k: int = 5, few: int = 10) -> DataFrame:
    """Basis functions per state -> state, rounds, size: ``k``, but up to ``few`` rounds three fewer than there are rounds.

    A round counts where its estimated number of infections is known. At least one function stays, the constant.
    """
    rounds = prepared.groupBy("state").agg(F.count("mean_sero").cast("int").alias("rounds"))
    return rounds.withColumn("size", F.when(F.col("rounds") > few, F.lit(k)).otherwise(F.greatest(F.col("rounds") - 3, F.lit(1))))


def serosurvey_smooth(prepared: DataFrame, k: int = 5, penalty: float | None = None, few: int = 10) -> DataFrame:
    """Smooth seroprevalence for every week on the grid -> state, week, mean_pred."""
    fitted = binomial_smooth(prepared, "state", "t", "success", "n", k, penalty, basis_sizes(prepared, k, few).drop("rounds"))
    weeks = prepared.select("t", "week").distinct()
    return natural_join(fitted, weeks, ["t"], "inner").select("state", "week", F.col("fit").alias("mean_pred"))


def poststratify(
    cases_daily: DataFrame,
    geo: DataFrame,
    sero_fit: DataFrame,
    population: DataFrame,
    excluded=places.TERRITORIES,
    dropped=(2997,),
    city: bool = True,
) -> DataFrame:
    """Spread a state's seroprevalence over its places by their reported cases.

    -> week, fips, state, n_covid, mean_pred, pop, n_cases_state, pop_state, r, p_immune.
    """
    cases = mean_cumulative(cases_daily, city)
    cases = cases.filter(F.col("fips").isNotNull() & ~in_set(F.col("fips"), [*dropped, *excluded]))
    panel = natural_join(cases, geo.select("fips", "state"), ["fips"])
    sizes = population.select("fips", F.col("pop").cast("long").alias("pop")).distinct()
    panel = natural_join(panel, sizes, ["fips"])
    panel = natural_join(panel, sero_fit.select("week", "state", "mean_pred").distinct(), ["state", "week"])
    panel = with_group_stats(
        panel,
        ["week", "state"],
        n_cases_state=skip_sum(F.col("n_covid")),
        pop_state=strict_sum(F.col("pop")),
        __level=weighted_mean(F.col("mean_pred"), F.col("pop")),
    )
    known = panel.filter(F.col("mean_pred").isNotNull())
    p_cases = ratio(F.col("n_cases_state").cast("double"), F.col("pop_state").cast("double"))
    known = known.withColumn("r", ratio(F.col("__level"), p_cases)).drop("__level")
    return known.withColumn("p_immune", ratio(F.col("r") * F.col("n_covid"), F.col("pop").cast("double")))


def state_sero_counts(clean: DataFrame, leave_out=("CA", "NY")) -> DataFrame:
    """Seropositive people per state and round, for states with suspected cases.

    Adds ``mean_sero_int`` = mean.sero percent of the population, and scales cases to thousands.
    """
    known = clean.filter(
        F.col("suspected_covid_cases").isNotNull() & F.col("mean_sero").isNotNull() & ~F.col("state").isin(*leave_out)
    )
    return known.withColumns(
        {
            "suspected_covid_cases": F.col("suspected_covid_cases") / 1000,
            "mean_sero_int": (F.col("mean_sero") * F.col("pop") / 100).cast("long"),
        }
    )
