"""Ratio of indoor to outdoor visits, with small places filled from their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_of
from ..functions.nulls import ratio
from .joins import attach, natural_join
from .panel import filled_up_down, over_group_mean
from .reshape import stack

IN, OUT = "raw_visitor_counts_Indoors", "raw_visitor_counts_Outdoor"
IN_MAX, OUT_MAX = "indoor_max_2019", "outdoor_max_2019"
IN_DWELL, OUT_DWELL = "median_dwell_Indoors", "median_dwell_Outdoor"

# A place with fewer visits in a week, or a smaller maximum, is a small sample.
MIN_INDOOR, MIN_OUTDOOR, MIN_MAXIMUM = 100, 80, 100


def poi_prepare(*years: DataFrame) -> DataFrame:
    """Visits per place and week -> fips, date, mean counts, maxima, dwell times.

    Repeated rows of a week are averaged. A place without a maximum in a week takes its next one,
    else its last one.
    """
    rows = stack(*[y.withColumnRenamed("countyFIPS", "fips") for y in years])
    weekly = rows.groupBy("fips", week_of(F.col("date")).alias("date")).agg(
        *[F.avg(c).alias(c) for c in (IN, OUT)],
        *[F.max(c).alias(c) for c in (IN_MAX, OUT_MAX)],
        *[F.avg(c).alias(c) for c in (IN_DWELL, OUT_DWELL)],
    )
    return weekly.withColumns({c: filled_up_down(c, ["fips"], ["date"]) for c in (IN_MAX, OUT_MAX)})


def small_sample_set(
    poi: DataFrame,
    geo: DataFrame,
    min_indoor: float = MIN_INDOOR,
    min_outdoor: float = MIN_OUTDOOR,
    min_maximum: float = MIN_MAXIMUM,
) -> DataFrame:
    """Places with at least one week of too few or unknown visits, or without any data -> fips."""
    small = F.lit(False)
    for c, least in ((IN, min_indoor), (OUT, min_outdoor), (OUT_MAX, min_maximum), (IN_MAX, min_maximum)):
        small = small | F.col(c).isNull() | (F.col(c) < least)
    flagged = poi.groupBy("fips").agg(F.bool_or(small).alias("small"))
    listed = geo.filter(F.col("state").isNotNull()).select("fips")
    every = natural_join(listed, flagged, ["fips"], "full")
    return every.filter(F.coalesce("small", F.lit(True))).select("fips")


def _pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg(IN).alias("num_indoor"),
        F.avg(OUT).alias("num_outdoor"),
        F.avg(IN_MAX).alias("denom_indoor"),
        F.avg(OUT_MAX).alias("denom_outdoor"),
    )


def neighbor_pool(poi: DataFrame, neighbors: DataFrame, geo: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean visits around each target place -> fips, date, num_*, denom_*, r.

    A place with listed neighbours pools those. The others pool all unlisted places of their state;
    that mean is the same for each of them, so it is taken once per state and week and no pairs of
    places are formed.
    """
    measures = poi.select("fips", "date", IN, OUT, IN_MAX, OUT_MAX)
    pairs = natural_join(neighbors.select("fips", "neighb").distinct(), targets, ["fips"], "semi")
    around = measures.withColumnRenamed("fips", "neighb")
    listed = _pooled(attach(around, pairs, ["neighb"], "inner"), ["fips", "date"])
    unlisted = natural_join(
        geo.filter(F.col("state").isNotNull()).select("fips", "state"), neighbors.select("fips").distinct(), ["fips"], "anti"
    )
    of_state = _pooled(attach(measures, unlisted, ["fips"], "inner"), ["state", "date"])
    wanted = natural_join(unlisted, targets, ["fips"], "semi")
    fallback = attach(of_state, wanted, ["state"], "inner").drop("state")
    pooled = stack(listed, fallback)
    indoor = ratio(F.col("num_indoor"), F.col("denom_indoor"))
    outdoor = ratio(F.col("num_outdoor"), F.col("denom_outdoor"))
    return pooled.withColumn("r", ratio(indoor, outdoor)).filter(F.col("date").isNotNull())


def _use(count: str, maximum: str, dwell: Column | None) -> Column:
    weighted = F.col(count) if dwell is None else F.col(count) * dwell
    return ratio(weighted, F.col(maximum))


def indoor_outdoor_ratio(
    poi: DataFrame,
    neighbors: DataFrame,
    geo: DataFrame,
    dwell: bool = False,
    min_indoor: float = MIN_INDOOR,
    min_outdoor: float = MIN_OUTDOOR,
    min_maximum: float = MIN_MAXIMUM,
) -> DataFrame:
    """Relative indoor over relative outdoor use, centred per place -> date, fips, r.

    Small places take the ratio pooled around them. With ``dwell`` visits are weighted by the time
    spent (pooled ratios are not) and rows without a ratio are left out.
    """
    small = small_sample_set(poi, geo, min_indoor, min_outdoor, min_maximum)
    times = (F.col(IN_DWELL), F.col(OUT_DWELL)) if dwell else (None, None)
    own = ratio(_use(IN, IN_MAX, times[0]), _use(OUT, OUT_MAX, times[1]))
    large = natural_join(poi, small, ["fips"], "anti").select("fips", "date", own.alias("r"))
    pooled = neighbor_pool(poi, neighbors, geo, small).select("fips", "date", "r")
    centred = over_group_mean(stack(large, pooled), "r", ["fips"])
    rows = centred.filter(F.col("date").isNotNull() & F.col("fips").isNotNull()).select("date", "fips", "r")
    return rows.filter(F.col("r").isNotNull()) if dwell else rows
