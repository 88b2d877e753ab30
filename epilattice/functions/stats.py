"""Closed-form statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ratio


def standardised(x: Column, mean: Column, sd: Column) -> Column:
    return ratio(x - mean, sd)


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def se_from_interval(low: Column, high: Column, width: float = 3.92) -> Column:
    """Standard error from the bounds of a 95% interval under a normal shape."""
    return (high - low) / F.lit(width)


def bernoulli_spread(p: Column) -> Column:
    return p * (1 - p)


def share_over(x: Column, threshold: float, two_sided: bool = True) -> Column:
    """Share of known values beyond a threshold."""
    over = (F.abs(x) if two_sided else x) > threshold
    return F.avg(over.cast("int"))


def partial_correlation(r_xy: Column, r_xz: Column, r_yz: Column) -> Column:
    """Correlation of x and y once z is held fixed, from the three plain correlations."""
    return ratio(r_xy - r_xz * r_yz, F.sqrt((1 - r_xz * r_xz) * (1 - r_yz * r_yz)))


def f_upper_tail(f: Column, df: Column) -> Column:
    """P(F > f) for an F distribution with (1, df) degrees of freedom, df a positive integer.

    F(1, df) is the square of Student's t, whose distribution function is a finite trigonometric
    series for whole degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4). The series has
    df / 2 terms, so the work is bounded by the length of one entity's calendar.
    """
    theta = F.atan(F.sqrt(f / df))
    cos2 = F.pow(F.cos(theta), 2)
    odd = (df % 2) == 1
    # Both series start at 1 (times cos for odd df); term m follows from term m-1.
    steps = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def advance(acc: Column, m: Column) -> Column:
        factor = F.when(odd, 2 * m / (2 * m + 1)).otherwise((2 * m - 1) / (2 * m))
        term = acc["term"] * factor * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    orders = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(orders, first, advance, lambda acc: acc["total"])
    sin, cos = F.sin(theta), F.cos(theta)
    inside_odd = (2 / F.pi()) * (theta + F.when(df == 1, F.lit(0.0)).otherwise(sin * cos * series))
    inside = F.when(odd, inside_odd).otherwise(sin * series)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))
