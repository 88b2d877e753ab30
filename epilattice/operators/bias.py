"""Ratio of observed to modelled reproduction, and filling of its gaps from nearby places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.nulls import ratio
from .joins import natural_join
from .panel import drop_null_duplicates, impute_group_mean
from .reshape import stack


def bias_ratio(risk: DataFrame, rt: DataFrame, start=None, end=None, min_incidence: float = 50) -> DataFrame:
    """Mean Rt over mean modelled risk in a period -> fips, R_risk, Rt, bg.

    Weeks strictly between ``start`` and ``end`` with more than ``min_incidence`` cases.
    """
    modelled = risk.select(F.col("j").alias("fips"), "week", "Ri")
    both = natural_join(modelled, rt.select("fips", "week", "Rt", "incidence"), ["fips", "week"], "full")
    rows = both.filter(F.col("incidence") > min_incidence)
    if start is not None:
        rows = rows.filter(F.col("week") > F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("week") < F.lit(end).cast("date"))
    means = rows.groupBy("fips").agg(F.avg("Ri").alias("R_risk"), F.avg("Rt").alias("Rt"))
    return means.withColumn("bg", ratio(F.col("Rt"), F.col("R_risk")))


def fill_from_state(values: DataFrame, place_list: DataFrame, geo: DataFrame) -> DataFrame:
    """A value for every listed place: its own, else the mean of its state -> fips, bg."""
    listed = natural_join(place_list.select("fips").distinct(), values.select("fips", "bg"), ["fips"], "full")
    filled = impute_group_mean(natural_join(listed, geo.select("fips", "state"), ["fips"]), "bg", ["state"])
    return filled.select(places.renamed(F.col("fips")).alias("fips"), "bg")


def neighbor_impute(
    values: DataFrame,
    neighbors: DataFrame,
    geo: DataFrame,
    passes: int = 2,
    second_pass: str = "own",
    collapse=places.NEW_YORK_CITY,
    collapse_key: int = places.NEW_YORK_CITY_KEY,
    excluded=places.TERRITORIES,
) -> DataFrame:
    """Fill missing values from neighbours, then from the state -> fips, bg, one row per listed place.

    A missing place takes the mean of its neighbours' values; the members of the collapsed set count
    as one place there. What is still missing takes the mean of its state. The second pass looks
    again at places that had no neighbour with a value: at their own filled value ('own', which
    leaves the state mean) or at their neighbours' filled values ('neighbors'). Members of the
    collapsed set that have a row take the value of its key.
    """
    if second_pass not in ("own", "neighbors"):
        raise ValueError("second_pass is 'own' or 'neighbors'")
    observed = values.select("fips", "bg")
    listed = places.without(geo.filter(F.col("state").isNotNull()).select("fips", "state"), excluded)
    missing = natural_join(listed, observed, ["fips"]).filter(F.col("bg").isNull())
    missing = missing.select(places.renamed(F.col("fips")).alias("fips")).distinct()
    around = neighbors.select(places.collapse(F.col("fips"), collapse, collapse_key).alias("fips"), "neighb").distinct()
    around = natural_join(around, missing, ["fips"], "semi")

    def mean_around(source: DataFrame) -> DataFrame:
        known = source.select(places.collapse(F.col("fips"), collapse, collapse_key).alias("neighb"), "bg")
        return natural_join(around, known, ["neighb"]).groupBy("fips").agg(F.avg("bg").alias("bg"))

    def filled(rows: DataFrame) -> DataFrame:
        unique = drop_null_duplicates(rows, ["fips"], "bg")
        placed = natural_join(unique, geo.select("fips", "state"), ["fips"])
        return impute_group_mean(placed, "bg", ["state"]).select("fips", "bg")

    first = mean_around(observed)
    full = filled(stack(observed, first))
    if passes > 1 and second_pass == "neighbors":
        unreached = first.filter(F.col("bg").isNull()).select("fips")
        again = natural_join(mean_around(full), unreached, ["fips"], "semi").filter(F.col("bg").isNotNull())
        full = stack(natural_join(full, again.select("fips"), ["fips"], "anti"), again)
    city = full.filter(F.col("fips") == collapse_key).agg(F.first("bg").alias("bg")).scalar()
    full = full.withColumn("bg", F.when(F.col("fips").isin(*collapse), city).otherwise(F.col("bg")))
    every = geo.filter(F.col("state").isNotNull()).select("fips", "state")
    whole = natural_join(every, full, ["fips"])
    return impute_group_mean(whole, "bg", ["state"]).select("fips", "bg")
