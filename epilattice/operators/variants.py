"""Lineage shares from genome records and what they imply for transmission and vaccines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import week_of
from ..functions.nulls import if_else, in_set, strict_sum
from ..functions.text import piece
from ..session import settle
from .joins import natural_join
from .panel import share_of_group

# Transmissibility of each lineage relative to the wild type.
TRANSMISSIBILITY = {
    "alpha": 1.5,
    "beta": 1.6,
    "gamma": 1.4,
    "delta": 2.4,
    "epsilon": 1.24,
    "eta": 1.29,
    "kappa": 1.48,
    "iota": 1.35,
    "zeta": 1.0,
    "other": 1.0,
    "omicron": 4.65,
    "mu": 2.25,
}

# Lineages tracked by the vaccine model, and vaccine effectiveness per lineage.
TRACKED = ["alpha", "delta", "other", "omicron"]
EFFECTIVENESS = {
    "partial": {"alpha": 1.0, "delta": 0.33, "other": 1.0, "omicron": 0.0},
    "complete": {"alpha": 1.0, "delta": 1.0, "other": 0.9, "omicron": 0.01},
}

# State names that stand for no state.
NOT_A_STATE = ["", "nan", "Southwest"]


def transmissibility_table(spark: SparkSession, values: dict | None = None) -> DataFrame:
    rows = list((TRANSMISSIBILITY if values is None else values).items())
    return spark.createDataFrame(rows, "lineage string, transmissibility_multiplier double")


def effectiveness_table(spark: SparkSession, values: dict | None = None) -> DataFrame:
    """One row per lineage with the effectiveness of partial and complete vaccination."""
    table = EFFECTIVENESS if values is None else values
    rows = [(x, table["partial"][x], table["complete"][x]) for x in table["partial"]]
    return spark.createDataFrame(rows, "lineage string, eff_partial double, eff_complete double")


def lineage_shares(genomes: DataFrame, start=None, end=None, country: str = "USA") -> DataFrame:
    """Share of each lineage among a state's genomes of a week -> state, week, lineage, n, n_total, p.

    A record without a sublineage has an unknown lineage, which counts as a lineage of its own. The counts are stored
    first, so the records are read once, also where the totals are not used.
    """
    rows = genomes
    if start is not None:
        rows = rows.filter(F.col("collection_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("collection_date") <= F.lit(end).cast("date"))
    rows = rows.filter(piece(F.col("location"), "/", 3, 2) == country)
    word = piece(F.col("variant"), " ", 3, 2)
    named = if_else(word.isin("", "undefined", "Other"), F.lit("other"), word)
    lineage = F.lower(if_else(F.col("pango_lineage") == "BA.1", F.lit("Omicron"), named))
    counts = (
        rows.select(
            piece(F.col("location"), "/", 4, 3).alias("state"),
            week_of(F.col("collection_date")).alias("week"),
            lineage.alias("lineage"),
        )
        .groupBy("state", "week", "lineage")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # On the stored counts, as the filter would be moved down to the records, each cut into pieces once more for it.
    counts = settle(counts, "lineage-counts").filter(~F.col("state").isin(*NOT_A_STATE))
    return share_of_group(counts, "n", ["state", "week"], "n_total", "p")


def collapse_lineages(shares: DataFrame, tracked=TRACKED) -> DataFrame:
    """Fold untracked lineages into 'other' and take shares again -> week, state, lineage, n, n_total, p."""
    name = F.lower("lineage")
    folded = F.when(in_set(name, tracked), name).otherwise(F.lit("other"))
    counts = shares.groupBy("week", "state", folded.alias("lineage")).agg(F.sum("n").alias("n"))
    return share_of_group(counts, "n", ["week", "state"], "n_total", "p")


def transmissibility_multiplier(shares: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Mean transmissibility of a state's lineages -> state, week, beta_mult.

    A lineage without a known multiplier makes the whole cell missing.
    """
    known = transmissibility_table(shares.sparkSession) if table is None else table
    joined = natural_join(shares, known, ["lineage"])
    return joined.groupBy("state", "week").agg(
        strict_sum(F.col("p") * F.col("transmissibility_multiplier")).alias("beta_mult")
    )


def vaccine_effectiveness(shares: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Effectiveness against a state's lineage mix -> week, state, partial, complete.

    A lineage without a known effectiveness makes the whole cell missing.
    """
    known = effectiveness_table(shares.sparkSession) if table is None else table
    joined = natural_join(shares, known, ["lineage"])
    return joined.groupBy("week", "state").agg(
        strict_sum(F.col("p") * F.col("eff_partial")).alias("partial"),
        strict_sum(F.col("p") * F.col("eff_complete")).alias("complete"),
    )


def with_state_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Swap full state names for the codes of a (state_name, state) table; unknown names stay."""
    keyed = names.select(F.col("state_name").alias("state"), F.col("state").alias("__code"))
    return natural_join(df, keyed, ["state"]).withColumn("state", F.coalesce("__code", "state")).drop("__code")


