"""Exact group quantiles that never hold one group in a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach, natural_join

# A group's values are dealt into this many buckets between cut points from a sketch. The cut points only decide how
# even the buckets are: counts and ranks are exact for any of them.
BUCKETS = 128
ACCURACY = 10_000


def _buckets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value occurs, with its bucket. Equal values are one row before anything is ranked."""
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    ends = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, ends, ACCURACY).alias("__cuts"))
    placed = attach(rows, cuts, keys, "inner")
    bucket = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return placed.groupBy(*keys, bucket.alias("__b"), value).agg(F.count(F.lit(1)).alias("__m"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, one column per name.

    Buckets are counted and put in order first, at most ``BUCKETS`` rows per group; only the buckets that hold a wanted
    order statistic are ranked, each for itself. A group without known values gets missing quantiles.
    """
    levels = _buckets(df, keys, value)
    in_order = Window.partitionBy(*keys).orderBy("__b")
    counts = levels.groupBy(*keys, "__b").agg(F.sum("__m").alias("__n"))
    counts = counts.withColumn("__upto", F.sum("__n").over(in_order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    place = {name: (F.col("__all") - 1) * F.lit(p) for name, p in probs.items()}
    ends = [F.struct(F.lit(name).alias("name"), F.lit(k).alias("end"), f(at).cast("long").alias("rank"), (at - F.floor(at)).alias("part")) for name, at in place.items() for k, f in enumerate((F.floor, F.ceil))]
    wanted = counts.withColumn("__w", F.explode(F.array(*ends))).filter((F.col("__w.rank") < F.col("__upto")) & (F.col("__w.rank") >= F.col("__upto") - F.col("__n")))
    wanted = wanted.select(*keys, "__b", "__w", (F.col("__w.rank") - F.col("__upto") + F.col("__n")).alias("__inside"))
    own = natural_join(levels, wanted.select(*keys, "__b").distinct(), [*keys, "__b"], "semi")
    own = own.withColumn("__last", F.sum("__m").over(Window.partitionBy(*keys, "__b").orderBy(value)))
    met = natural_join(wanted, own, [*keys, "__b"], "inner")
    met = met.filter((F.col("__inside") < F.col("__last")) & (F.col("__inside") >= F.col("__last") - F.col("__m")))

    def at(name: str, end: int):
        found = F.max(F.when((F.col("__w.name") == name) & (F.col("__w.end") == end), F.col(value)))
        return F.coalesce(found, F.raise_error(F.lit(f"an order statistic of {name} was not found")).cast("double"))

    def part(name: str):
        return F.max(F.when(F.col("__w.name") == name, F.col("__w.part")))

    picked = met.groupBy(*keys).agg(*[(at(n, 0) + (at(n, 1) - at(n, 0)) * part(n)).alias(n) for n in probs])
    return natural_join(df.select(*keys).distinct(), picked, keys)


def draw_summary(draws: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Mean, sd and the 2.5% and 97.5% quantile of the draws of each variable."""
    moments = draws.groupBy(variable).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    bounds = group_quantiles(draws, [variable], value, {"lower": 0.025, "upper": 0.975})
    return natural_join(moments, bounds, [variable])
