"""Checks of modelled risk against the observed reproduction number.

``joined`` tables hold fips, week, Rt, Ri and, where needed, cases_j and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import shift_weeks
from ..functions.nulls import ratio
from ..functions.stats import f_upper_tail, partial_correlation
from .joins import natural_join
from .panel import distinct_values, lagged, over_group_mean, rolling_mean, z_score
from .quantiles import draw_summary
from .reshape import index_of, stem_of


def join_estimates(rt: DataFrame, risk: DataFrame) -> DataFrame:
    """Both estimates of a place and week side by side."""
    return natural_join(rt, risk.withColumnRenamed("j", "fips"), ["fips", "week"], "full")


def shifted_compare(risk: DataFrame, rt: DataFrame, weeks: int = 3) -> DataFrame:
    """Risk moved forward in time, next to the Rt of the later week."""
    moved = risk.withColumnRenamed("j", "fips").withColumn("week", shift_weeks(F.col("week"), weeks))
    return natural_join(moved, rt, ["fips", "week"])


def z_compare(joined: DataFrame) -> DataFrame:
    """Both estimates standardised per place -> + z_Rt, z_Ri."""
    return z_score(z_score(joined, "Rt", ["fips"], "z_Rt"), "Ri", ["fips"], "z_Ri")


def compare_forecasts(joined: DataFrame, limit: float = 5, window: int = 3) -> DataFrame:
    """Squared errors of the model, of last week's value and of a moving mean -> fips, sse_*.

    Only weeks where all three errors are known count.
    """
    by, order = ["fips"], ["week"]
    rows = joined.filter((F.col("Rt") < limit) & (F.col("Ri") < limit)).select("fips", "week", "Rt", "Ri")
    errors = rows.select(
        "fips",
        F.pow(F.col("Ri") - F.col("Rt"), F.lit(2)).alias("model"),
        F.pow(F.col("Rt") - lagged("Rt", by, order), F.lit(2)).alias("naive"),
        F.pow(F.col("Rt") - rolling_mean("Rt", by, order, 0, window - 1), F.lit(2)).alias("moving"),
    ).dropna()
    return errors.groupBy("fips").agg(*[F.sum(c).alias(f"sse_{c}") for c in ("model", "naive", "moving")])


def residual_z(
    joined: DataFrame,
    by: list[str],
    scale: str | None = None,
    diff: bool = False,
    min_incidence: float | None = None,
) -> DataFrame:
    """Rt minus Ri and its z-score within groups -> + resid, z_resid.

    ``scale='mean'`` first divides Ri by its mean per place. ``diff`` replaces Rt by its weekly step
    over the step's mean per place.
    """
    if scale not in (None, "mean"):
        raise ValueError("scale is None or 'mean'")
    rows = joined if min_incidence is None else joined.filter(F.col("cases_j") > min_incidence)
    if scale == "mean":
        rows = over_group_mean(rows, "Ri", ["fips"])
    if diff:
        rows = rows.withColumn("Rt", F.col("Rt") - lagged("Rt", ["fips"], ["week"]))
        rows = over_group_mean(rows, "Rt", ["fips"])
    return z_score(rows.withColumn("resid", F.col("Rt") - F.col("Ri")), "resid", by, "z_resid")


def region_rollup(joined: DataFrame, regions: DataFrame, **options) -> DataFrame:
    """``residual_z`` per region of a (fips, region) table; places without a region are left out."""
    placed = natural_join(joined, regions, ["fips"]).filter(F.col("region").isNotNull())
    return residual_z(placed, ["region"], **options)


def group_correlation(joined: DataFrame, by: list[str]) -> DataFrame:
    known = joined.filter(F.col("Ri").isNotNull() & F.col("Rt").isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("Ri", "Rt").alias("rho"))


def granger(joined: DataFrame, min_obs: int = 25) -> DataFrame:
    """Does last week's risk help to predict Rt beyond last week's Rt? -> fips, n, F, p.

    One lag. F follows from the partial correlation of Rt_t and Ri_(t-1) given Rt_(t-1).
    """
    known = joined.filter(F.col("Ri").isNotNull() & F.col("Rt").isNotNull()).select("fips", "week", "Rt", "Ri")
    lags = known.select(
        "fips",
        F.col("Rt").alias("y"),
        lagged("Ri", ["fips"], ["week"]).alias("x"),
        lagged("Rt", ["fips"], ["week"]).alias("z"),
    )
    fits = lags.groupBy("fips").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("x").cast("int").alias("n"),
        *[F.corr(F.when(F.col("x").isNotNull(), F.col(a)), F.col(b)).alias(f"{a}{b}") for a, b in (("y", "x"), ("y", "z"), ("x", "z"))],
    )
    r = partial_correlation(F.col("yx"), F.col("yz"), F.col("xz"))
    r2 = r * r
    free = F.col("n") - 3
    scored = fits.filter(F.col("rows") > min_obs).withColumn("F", free * ratio(r2, 1 - r2))
    return scored.select("fips", "n", "F", f_upper_tail(F.col("F"), free).alias("p"))


def granger_share(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Share of places with a significant test, in one row."""
    return tests.agg(F.avg((F.col("p") < level).cast("int")).alias("share"), F.count("p").alias("n"))


def lm_trend(df: DataFrame, by: list[str], x: str = "Ri", y: str = "Rt") -> DataFrame:
    """Straight line per group -> by, n, slope, intercept, r2."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def draw_index_join(draws: DataFrame, place_list: DataFrame, weeks: DataFrame) -> DataFrame:
    """Summaries of indexed draws with the place and week that the indices stand for.

    The index counts places by code and weeks by date. -> fips, week, variable, mean, sd, lower, upper.
    """
    summary = draw_summary(draws)
    placed = summary.withColumns(
        {"__places": distinct_values(place_list, "fips"), "__weeks": distinct_values(weeks, "week")}
    )
    return placed.select(
        F.try_element_at("__places", index_of(F.col("variable"), 1)).alias("fips"),
        F.try_element_at("__weeks", index_of(F.col("variable"), 2)).alias("week"),
        stem_of(F.col("variable")).alias("variable"),
        "mean", "sd", "lower", "upper",
    )

