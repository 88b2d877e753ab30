"""Time-varying reproduction number from the renewal equation (Cori et al. 2013)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights below this are zero in double precision next to a sum of one.
NEGLIGIBLE = 1e-16


def _gamma_cdf(x: float, shape: float, scale: float) -> float:
    """Regularised lower incomplete gamma function, by its power series or its continued fraction."""
    if x <= 0:
        return 0.0
    y = x / scale
    lead = math.exp(shape * math.log(y) - y - math.lgamma(shape))
    if y < shape + 1:
        term = total = 1 / shape
        k = shape
        while term > total * 1e-17:
            k += 1
            term *= y / k
            total += term
        return lead * total
    tiny = 1e-300
    b = y + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 4e-16:
            return 1 - lead * h
    raise ArithmeticError(f"the continued fraction for shape {shape} at {y} did not settle")


def serial_interval(mean_si: float = 5.5, sd_si: float = 4.2, length: int | None = None) -> list[float]:
    """Probability of a serial interval of 0, 1, 2, ... steps for a gamma shifted by one step.

    Without a ``length`` the list ends where the weights vanish in double precision.
    """
    shape, scale = ((mean_si - 1) / sd_si) ** 2, sd_si**2 / (mean_si - 1)

    def cdf(k: float, extra: float = 0) -> float:
        return _gamma_cdf(k, shape + extra, scale)

    weights: list[float] = []
    k = 0
    while length is None or k < length:
        mass = k * cdf(k) + (k - 2) * cdf(k - 2) - 2 * (k - 1) * cdf(k - 1)
        mean = shape * scale * (2 * cdf(k - 1, 1) - cdf(k - 2, 1) - cdf(k, 1))
        weights.append(max(0.0, mass + mean))
        # Rounding noise of the differences is of the order of k times the machine epsilon.
        if length is None and k > mean_si and weights[-1] < NEGLIGIBLE + 4e-16 * k:
            weights.pop()
            break
        k += 1
    return weights


def renewal_rt(
    incidence: DataFrame,
    mean_si: float = 5.5,
    sd_si: float = 4.2,
    window: int = 7,
    prior: tuple[float, float] = (5.0, 5.0),
    start=None,
    align: str = "window",
) -> DataFrame:
    """Posterior mean and sd of R in a sliding window -> fips, week, Rt, Rt_sd, incidence.

    ``incidence`` is a dense panel fips, week, cases. With shape a and scale b of the gamma prior, the
    window [t, t + window - 1] gives (a + sum I) / (1 / b + sum Lambda), where Lambda_t is the weighted
    sum of earlier cases; the first window starts at the second step. A result stands at the middle of
    its window. ``start`` leaves earlier weeks out of the fit; with ``align='reference'`` results are
    then numbered from the first week of the panel instead of the first week of the fit.
    """
    if align not in ("window", "reference"):
        raise ValueError("align is 'window' or 'reference'")
    weights = serial_interval(mean_si, sd_si)[1:]
    shape = (prior[0] / prior[1]) ** 2
    scale = prior[1] ** 2 / prior[0]
    order = Window.partitionBy("fips").orderBy("week")
    rows = incidence.select("fips", "week", F.col("cases").cast("double").alias("incidence"))
    full = rows
    if start is not None:
        rows = rows.filter(F.col("week") > F.lit(start).cast("date"))
    # Cases of the steps before, latest last; one place's steps are bounded by the calendar.
    past = F.collect_list(F.coalesce("incidence", F.lit(0.0))).over(order.rowsBetween(-len(weights), -1))
    steps = rows.withColumn("past", past).withColumn("t", F.row_number().over(order))
    steps = steps.withColumn("pressure", _weighted_sum(F.reverse("past"), weights)).drop("past")
    before = (window - 1) // 2
    frame = order.rowsBetween(-before, window - 1 - before)
    steps = steps.withColumns(
        {
            "__n": F.count(F.lit(1)).over(frame),
            "__cases": F.sum("incidence").over(frame),
            "__pressure": F.sum("pressure").over(frame),
        }
    )
    # The window must be whole, start at the second step and end after the mean interval.
    usable = (F.col("__n") == window) & (F.col("t") - before >= 2) & (F.col("t") + (window - 1 - before) > mean_si)
    events = F.lit(shape) + F.col("__cases")
    rt = events / (F.lit(1 / scale) + F.col("__pressure"))
    fitted = steps.filter(usable).select(
        "fips", "week", "t", rt.alias("Rt"), (rt / F.sqrt(events)).alias("Rt_sd"), "incidence"
    )
    if align == "window":
        return fitted.drop("t")
    numbered = full.withColumn("t", F.row_number().over(order))
    return (
        fitted.select("fips", "t", "Rt", "Rt_sd")
        .join(numbered, ["fips", "t"])
        .select("fips", "week", "Rt", "Rt_sd", "incidence")
    )


def _weighted_sum(values: Column, weights: list[float]) -> Column:
    """Sum of values times the leading weights; the values may be fewer than the weights."""
    w = F.array(*[F.lit(x) for x in weights])
    terms = F.zip_with(values, F.slice(w, 1, F.size(values)), lambda v, x: v * x)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
