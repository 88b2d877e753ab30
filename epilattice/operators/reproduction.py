"""Spread between places and the risk it imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.nulls import ratio, skip_sum
from .joins import attach, natural_join

# A destination that is left out, as its county is part of the city's unit.
LEFT_OUT = (36005,)


def pair_reproduction(
    coupling: DataFrame,
    sigma: DataFrame,
    multiplier: DataFrame,
    geo: DataFrame,
    bg: DataFrame | None = None,
    left_out=LEFT_OUT,
    coupling_value: str = "mean",
) -> DataFrame:
    """New cases in j per case in i -> i, j, week, mean_R.

    R_ij = p_ij (1 - sigma_j) bg_j mult(state of j, week). The factors of a destination are first put
    together on the small place-by-week panel, so the coupling table takes part in one join only.
    A missing multiplier or bias ratio counts as one; an unknown sigma leaves R unknown.
    """
    panel = sigma.select("week", F.col("fips").alias("j"), "mean_sigma").distinct()
    panel = natural_join(panel, geo.select(F.col("fips").alias("j"), "state"), ["j"])
    panel = natural_join(panel, multiplier.select("state", "week", "beta_mult"), ["state", "week"])
    bias = F.lit(1.0)
    if bg is not None:
        panel = natural_join(panel, bg.select(F.col("fips").alias("j"), "bg"), ["j"])
        bias = F.coalesce("bg", F.lit(1.0))
    factor = (1 - F.col("mean_sigma")) * bias * F.coalesce("beta_mult", F.lit(1.0))
    panel = panel.select("week", "j", factor.alias("__factor"))
    rows = places.without(coupling.select("i", "j", "week", coupling_value), left_out, "j")
    joined = attach(rows, panel, ["j", "week"])
    return joined.select("i", "j", "week", (F.col(coupling_value) * F.col("__factor")).alias("mean_R"))


def total_reproduction(r_ij: DataFrame) -> DataFrame:
    """New cases anywhere per case in i -> i, week, R."""
    return r_ij.groupBy("i", "week").agg(skip_sum(F.col("mean_R"), 0.0).alias("R"))


def _cases(incidence: DataFrame, role: str) -> DataFrame:
    return incidence.select("week", F.col("fips").alias(role), F.col("cases").alias(f"cases_{role}"))


def import_risk(
    r_ij: DataFrame, incidence: DataFrame, min_cases: float = 10, distinct_rows: bool = True
) -> DataFrame:
    """Incidence-weighted reproduction at the destination -> j, week, Ri, cases_j.

    Ri = R_jj + sum over i != j of R_ij cases_i / cases_j, for places with more than ``min_cases``
    cases; missing without a within-place R_jj. The cases of j are constant in a group and join
    after the aggregation. ``distinct_rows=False`` saves a shuffle when (i, j, week) is unique.
    """
    rows = r_ij.distinct() if distinct_rows else r_ij
    rows = attach(rows, _cases(incidence, "i"), ["i", "week"])
    within = F.col("i") == F.col("j")
    sums = rows.groupBy("j", "week").agg(
        F.max(F.when(within, F.col("mean_R"))).alias("R_jj"),
        skip_sum(F.when(~within, F.col("mean_R") * F.col("cases_i")), 0.0).alias("imported"),
    )
    placed = natural_join(sums, _cases(incidence, "j"), ["j", "week"]).filter(F.col("cases_j") > min_cases)
    risk = F.col("R_jj") + ratio(F.col("imported"), F.col("cases_j"))
    return placed.select("j", "week", risk.alias("Ri"), "cases_j")


def import_risk_variance(
    var_ij: DataFrame, incidence: DataFrame, min_cases: float = 10, distinct_rows: bool = True
) -> DataFrame:
    """Variance of the import risk when pairs are independent -> j, week, var_Ri, cases_j.

    ``var_ij`` is i, j, week, var_R.
    """
    rows = var_ij.distinct() if distinct_rows else var_ij
    rows = attach(rows, _cases(incidence, "i"), ["i", "week"])
    within = F.col("i") == F.col("j")
    squared = F.pow(F.col("cases_i").cast("double"), F.lit(2))
    sums = rows.groupBy("j", "week").agg(
        F.max(F.when(within, F.col("var_R"))).alias("var_jj"),
        skip_sum(F.when(~within, F.col("var_R") * squared), 0.0).alias("imported"),
    )
    placed = natural_join(sums, _cases(incidence, "j"), ["j", "week"]).filter(F.col("cases_j") > min_cases)
    risk = F.col("var_jj") + ratio(F.col("imported"), F.pow(F.col("cases_j").cast("double"), F.lit(2)))
    return placed.select("j", "week", risk.alias("var_Ri"), "cases_j")
