"""Share of a place's people who are immune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions.nulls import cap_at, null_above, null_outside
from ..functions.stats import bernoulli_spread
from .joins import natural_join
from .panel import fill_down

# Protection left after an infection, and effectiveness where the lineage mix is unknown.
PROTECTION = 0.8
UNKNOWN_MIX = {"complete": 0.9, "partial": 0.66}


def immunity(
    incidence: DataFrame,
    coverage: DataFrame,
    sero: DataFrame,
    effectiveness: DataFrame | None = None,
    eps_inf: float = PROTECTION,
    apply_effectiveness: bool = False,
    cap: str = "one",
    units: dict | None = None,
    resolved: bool = False,
) -> DataFrame:
    """Immune share from infections and vaccination, taken as independent -> week, fips, mean_sigma, se_sigma.

    ``incidence``: week, fips, mean_incidence[, se_incidence][, state]; ``coverage``: week, fips,
    complete, partial; ``sero``: week, fips, p_immune[, se_sero]. A place keeps its last
    seroprevalence; coverage and seroprevalence that never were known count as zero, unknown
    incidence leaves the result unknown. Jointly reported units pass their value to each county.
    With ``resolved``, ``sero`` comes from ``resolve_prevalence``: week, fips, mean_sero, se_sero, carried forward already,
    and a place without a value stays unknown.
    Coverage is used as reported unless ``apply_effectiveness`` is set. Values above one become one,
    or missing with ``cap='null'``.
    """
    if cap not in ("one", "null"):
        raise ValueError("cap is 'one' or 'null'")
    extra = [c for c in ("se_incidence", "state") if c in incidence.columns]
    panel = incidence.select("week", "fips", "mean_incidence", *extra)
    panel = natural_join(panel, coverage.select("week", "fips", "complete", "partial"), ["week", "fips"])
    if resolved:
        panel = natural_join(panel, sero.select("week", "fips", "mean_sero", "se_sero"), ["week", "fips"])
    else:
        known = sero.select("week", "fips", F.col("p_immune").alias("mean_sero"), *[c for c in sero.columns if c == "se_sero"])
        panel = natural_join(panel, known, ["week", "fips"])
        if "se_sero" not in panel.columns:
            panel = panel.withColumn("se_sero", bernoulli_spread(F.col("mean_sero")))
        panel = fill_down(panel, ["mean_sero", "se_sero"], ["fips"], ["week"])
    zero = ("complete", "partial") if resolved else ("complete", "partial", "mean_sero")
    panel = panel.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})
    if apply_effectiveness:
        if effectiveness is None:
            raise ValueError("apply_effectiveness needs the table of vaccine effectiveness")
        mix = effectiveness.select(
            "week", "state", F.col("complete").alias("__complete"), F.col("partial").alias("__partial")
        )
        panel = natural_join(panel, mix, ["week", "state"])
        for kind, default in UNKNOWN_MIX.items():
            panel = panel.withColumn(kind, F.col(kind) * F.coalesce(f"__{kind}", F.lit(default)))
    infected = F.col("mean_sero") * eps_inf
    both = infected * F.col("complete") + infected * F.col("partial")
    sigma = F.col("mean_incidence") + infected + F.col("complete") + F.col("partial") - both
    var_sero = F.pow("se_sero", F.lit(2)) * eps_inf**2
    var = var_sero + var_sero * F.pow("complete", F.lit(2)) + var_sero * F.pow("partial", F.lit(2))
    if "se_incidence" in panel.columns:
        var = F.pow("se_incidence", F.lit(2)) + var
    limit = cap_at if cap == "one" else null_above
    result = panel.select("week", "fips", limit(sigma, 1.0).alias("mean_sigma"), F.sqrt(var).alias("se_sigma"))
    result = places.split_units(result, "fips", units)
    return result.withColumn("fips", places.renamed(F.col("fips")))


def sigma_breakdown(sigma: DataFrame, coverage: DataFrame, incidence: DataFrame, sero: DataFrame) -> DataFrame:
    """The inputs next to the result -> week, fips, complete, partial, mean_sero, incidence, mean_sigma.

    Coverage and seroprevalence are carried forward; a seroprevalence outside [0, 1] is missing.
    """
    wide = natural_join(
        sigma.select("week", "fips", "mean_sigma"), coverage.select("week", "fips", "complete", "partial"), ["week", "fips"]
    )
    wide = natural_join(wide, incidence.select("week", "fips", F.col("mean_incidence").alias("incidence")), ["week", "fips"])
    wide = natural_join(wide, sero.select("week", "fips", F.col("p_immune").alias("mean_sero")), ["week", "fips"])
    wide = fill_down(wide, ["complete", "partial", "mean_sero"], ["fips"], ["week"])
    return wide.select(
        "week", "fips", "complete", "partial",
        null_outside(F.col("mean_sero"), 0.0, 1.0).alias("mean_sero"),
        "incidence", "mean_sigma",
    )
