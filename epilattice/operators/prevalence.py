"""Seroprevalence from several sources, and which of them a state takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bernoulli_spread, se_from_interval
from .joins import natural_join
from .panel import fill_down

PREVALENCE = ["week", "fips", "mean_sero", "se_sero"]


def survey_prevalence(sero: DataFrame) -> DataFrame:
    """A poststratified survey -> week, fips, mean_sero, se_sero; its error is that of a share."""
    return sero.select("week", "fips", F.col("p_immune").alias("mean_sero"), bernoulli_spread(F.col("p_immune")).alias("se_sero"))


def interval_prevalence(draws: DataFrame, mean: str = "mean", low: str = "2.5%", high: str = "97.5%", variable: str | None = None) -> DataFrame:
    """Summaries of a model's draws -> week, fips, mean_sero, se_sero; the error comes from the 95% interval.

    ``variable`` keeps the rows of one model variable. A week without a place, or a place without a week, has no value.
    """
    rows = draws if variable is None else draws.filter(F.col("variable") == variable)
    rows = rows.filter(F.col("week").isNotNull() & F.col("fips").isNotNull())
    return rows.select("week", "fips", F.col(f"`{mean}`").alias("mean_sero"), se_from_interval(F.col(f"`{low}`"), F.col(f"`{high}`")).alias("se_sero"))


def resolve_prevalence(
    panel: DataFrame, sources: dict[str, DataFrame], precedence: DataFrame, default: str, zero_if_unknown: tuple[str, ...] = ()
) -> DataFrame:
    """The prevalence that a place takes in a week -> week, fips, mean_sero, se_sero, source.

    ``panel``: week, fips, state, one row each; ``sources``: week, fips, mean_sero, se_sero by name; ``precedence``: state,
    source, place, since, until, where ``place`` 1 comes first and an open ``since`` or ``until`` has no bound (both ends
    count). A state without rows takes ``default``.

    Every source has its own series per place, which keeps its last known value, over all weeks of the panel. Of the
    sources that the state lists for a week, the first one that has a value is taken; its error may be missing. Where none
    has a value, ``source`` is missing and so is the value, but it is 0 where a listed source is in ``zero_if_unknown``.
    """
    unknown = set(zero_if_unknown) - set(sources) | {default} - set(sources)
    if unknown:
        raise ValueError(f"no source named {sorted(unknown)}")
    values = None
    for name, rows in sources.items():
        rows = rows.select(*PREVALENCE, F.lit(name).alias("source"))
        values = rows if values is None else values.unionByName(rows)
    names = F.explode(F.array(*[F.lit(name) for name in sources])).alias("source")
    series = natural_join(panel.select("week", "fips", "state", names), values, ["week", "fips", "source"])
    series = fill_down(series, ["mean_sero", "se_sero"], ["fips", "source"], ["week"])
    listed = precedence.select("state", "source", F.col("place").alias("__place"), F.col("since").alias("__since"), F.col("until").alias("__until"))
    ranked = natural_join(series, listed, ["state", "source"])
    ruled = natural_join(ranked, precedence.select("state", F.lit(True).alias("__ruled")).distinct(), ["state"])
    inside = (F.col("__since").isNull() | (F.col("week") >= F.col("__since"))) & (F.col("__until").isNull() | (F.col("week") <= F.col("__until")))
    place = F.when(F.col("__ruled"), F.when(F.col("__place").isNotNull() & inside, F.col("__place"))).when(F.col("source") == default, F.lit(1))
    ruled = ruled.withColumn("__place", place)
    first = F.min(F.when(F.col("__place").isNotNull() & F.col("mean_sero").isNotNull(), F.struct("__place", "source", "mean_sero", "se_sero")))
    zero = F.max(F.col("__place").isNotNull() & F.col("source").isin(*zero_if_unknown))
    chosen = ruled.groupBy("week", "fips").agg(first.alias("__first"), zero.alias("__zero"))
    mean = F.coalesce("__first.mean_sero", F.when(F.col("__zero"), F.lit(0.0)))
    return chosen.select("week", "fips", mean.alias("mean_sero"), F.col("__first.se_sero").alias("se_sero"), F.col("__first.source").alias("source"))
