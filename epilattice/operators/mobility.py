"""Cleaning and describing origin-destination edge tables.

Columns: origin_county_fips, destination_county_fips, date or week, and a measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places
from ..functions.dates import month_of, week_of, weeks_between
from ..functions.nulls import if_else, in_set, ratio, strict_mean, strict_sd, strict_sum
from ..functions.stats import share_over, standardised
from .joins import attach, natural_join, with_group_stats, with_scalars
from .panel import keep_large_groups, rolling_mean

ORIGIN = "origin_county_fips"
DEST = "destination_county_fips"
PAIR = [ORIGIN, DEST]


def allow_list(edges: DataFrame, geo: DataFrame, drop=places.CITY_CODES, always=(2158, 46102)) -> DataFrame:
    """Origins that the county list names, without the listed city codes -> fips.

    The county list is the left side and the added codes are literals, so Spark knows how small the result is and can
    broadcast it without a hint.
    """
    named = geo.filter(F.col("name").isNotNull()).select("fips")
    extra = edges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in always])).alias("fips"))
    candidates = named.unionByName(extra).distinct().filter(~in_set(F.col("fips"), drop))
    seen = edges.select(F.col(ORIGIN).alias("fips")).distinct()
    return natural_join(candidates, seen, ["fips"], "semi")


def clean_edges(
    edges: DataFrame,
    allowed: DataFrame | None = None,
    min_visits: float = 10,
    min_obs: int = 3,
    z_cap: float = 3,
    min_prop: float = 1e-4,
    after=None,
    null_policy: str = "strict",
    dedupe: bool = True,
) -> DataFrame:
    """Winsorised share of an origin's weekly visits per destination -> origin, dest, week, prop_population.

    A visit share that lies more than ``z_cap`` standard deviations from the mean of its pair moves
    to that bound. A pair without spread has no z-score: under 'strict' its value is missing and so
    is the origin's weekly total, which drops the whole origin-week; 'skip' keeps the share as is.
    Rows stay daily; equal rows of a week collapse when ``dedupe`` is set.

    Edge rows are dealt twice: by pair, where a window holds the days of one pair, and by origin and week, where it holds
    the destinations of seven days. A heavy origin is thus spread over its pairs, then over its weeks; no statistic
    returns by a join, and equal rows already lie together. ``allowed`` is a list of places, which Spark broadcasts as
    long as its size allows.
    """
    if null_policy not in ("strict", "skip"):
        raise ValueError("null_policy is 'strict' or 'skip'")
    rows = edges.filter(F.col("num_visits").isNotNull() & F.col("origin_total_num_visits").isNotNull())
    rows = rows.filter(F.col("num_visits") > min_visits).withColumn("week", week_of(F.col("date")))
    if after is not None:
        rows = rows.filter(F.col("week") > F.lit(after).cast("date"))
    if allowed is not None:
        for endpoint in PAIR:
            rows = natural_join(rows, allowed.toDF(endpoint), [endpoint], "semi")
    of_pair = Window.partitionBy(*PAIR)
    scored = rows.select(
        *PAIR,
        "week",
        F.col("origin_total_num_visits").alias("total"),
        ratio(F.col("num_visits"), F.col("origin_total_num_visits")).alias("p"),
    ).select(
        "*",
        F.count(F.lit(1)).over(of_pair).alias("n"),
        strict_mean(F.col("p"), of_pair).alias("mean"),
        strict_sd(F.col("p"), of_pair).alias("sd"),
    )
    scored = scored.filter(F.col("n") > min_obs)
    z = standardised(F.col("p"), F.col("mean"), F.col("sd"))
    low, high = F.col("mean") - z_cap * F.col("sd"), F.col("mean") + z_cap * F.col("sd")
    bounded = if_else(z > z_cap, high, if_else(z < -z_cap, low, F.col("p")))
    if null_policy == "skip":
        bounded = F.coalesce(bounded, F.col("p"))
    valued = scored.select(*PAIR, "week", (bounded * F.col("total")).alias("value"))
    total = strict_sum(F.col("value"), Window.partitionBy(ORIGIN, "week"))
    cleaned = valued.select(*PAIR, "week", ratio(F.col("value"), total).alias("prop_population"))
    cleaned = cleaned.filter(F.col("prop_population") > min_prop)
    return cleaned.distinct() if dedupe else cleaned


def upsert_edges(current: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together, averaged per pair and week."""
    return (
        current.unionByName(new)
        .groupBy(*PAIR, "week")
        .agg(strict_mean(F.col("prop_population")).alias("prop_population"))
    )


def edge_residuals(edges: DataFrame) -> DataFrame:
    """Deviation of each share from the destination's mean of the month -> + month, p, resid, z_resid."""
    monthly = with_group_stats(
        edges.withColumn("month", month_of(F.col("week"))), ["month", DEST], p=strict_mean(F.col("prop_population"))
    )
    resid = monthly.withColumn("resid", F.col("p") - F.col("prop_population"))
    scored = with_group_stats(resid, [DEST], __m=strict_mean(F.col("resid")), __s=strict_sd(F.col("resid")))
    z = standardised(F.col("resid"), F.col("__m"), F.col("__s"))
    return scored.withColumn("z_resid", z).drop("__m", "__s")


def threshold_shares(df: DataFrame, column: str, thresholds=(5, 4, 2, 1), two_sided: bool = True) -> DataFrame:
    """Share of values beyond each threshold, in one row."""
    return df.agg(*[share_over(F.col(column), k, two_sided).alias(f"over_{k}") for k in thresholds])


def _long_pairs(edges: DataFrame, min_obs: int) -> DataFrame:
    first = with_scalars(edges, __start=F.min("week"))
    indexed = first.withColumn("week_index", weeks_between(F.col("__start"), F.col("week")) + 1).drop("__start")
    return keep_large_groups(indexed, PAIR, min_obs).withColumn("month", month_of(F.col("week")))


def edge_standardise(edges: DataFrame, min_obs: int = 60, k: int = 3) -> DataFrame:
    """Standardised series of well-observed pairs -> + week_index, month, z, month_mean, ma.

    ``edges`` has one row per pair and week.
    """
    rows = with_group_stats(
        _long_pairs(edges, min_obs),
        PAIR,
        __m=strict_mean(F.col("prop_population")),
        __s=strict_sd(F.col("prop_population")),
    )
    z = standardised(F.col("prop_population"), F.col("__m"), F.col("__s"))
    rows = rows.withColumn("z", z).drop("__m", "__s")
    rows = with_group_stats(rows, ["month", DEST], month_mean=strict_mean(F.col("z")))
    half = k // 2
    return rows.withColumn("ma", rolling_mean("z", PAIR, ["week"], half, half))


def edge_scaled(
    edges: DataFrame, contact: DataFrame, bg: DataFrame, min_obs: int = 60, k: int = 3
) -> DataFrame:
    """Shares of well-observed pairs times the origin's contact rate and the destination's bias ratio.

    -> + week_index, month, month_mean, ma, fit, bg, scaled, scaled_month, scaled_ma.
    """
    rows = with_group_stats(
        _long_pairs(edges, min_obs), ["month", DEST], month_mean=strict_mean(F.col("prop_population"))
    )
    half = k // 2
    rows = rows.withColumn("ma", rolling_mean("prop_population", PAIR, ["week"], half, half))
    rows = attach(rows, contact.select(F.col("fips").alias(ORIGIN), "week", "fit"), [ORIGIN, "week"])
    rows = attach(rows, bg.select(F.col("fips").alias(DEST), "bg"), [DEST])
    weight = F.col("fit") * F.col("bg")
    return rows.withColumns(
        {
            "scaled": F.col("prop_population") * weight,
            "scaled_month": F.col("month_mean") * weight,
            "scaled_ma": F.col("ma") * weight,
        }
    )
