"""Missing-value rules. NULL is the only missing value; NaN is turned into NULL on entry."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def nullif_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Like CASE WHEN, but an unknown condition gives NULL instead of the ELSE branch."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def _over(x: Column, window: WindowSpec | None) -> Column:
    return x if window is None else x.over(window)


def _complete_group(*inputs: Column, over: WindowSpec | None = None) -> Column:
    missing = inputs[0].isNull()
    for x in inputs[1:]:
        missing = missing | x.isNull()
    return _over(F.count_if(missing), over) == 0


def strict_sum(x: Column, over: WindowSpec | None = None) -> Column:
    """NULL as soon as the group, or the window's partition, holds one NULL."""
    return F.when(_complete_group(x, over=over), _over(F.sum(x), over))


def strict_mean(x: Column, over: WindowSpec | None = None) -> Column:
    return F.when(_complete_group(x, over=over), _over(F.avg(x), over))


def strict_sd(x: Column, over: WindowSpec | None = None) -> Column:
    return F.when(_complete_group(x, over=over), _over(F.stddev_samp(x), over))


def skip_sum(x: Column, zero=0) -> Column:
    """Missing values are left out and the sum of nothing is zero."""
    return F.coalesce(F.sum(x), F.lit(zero))


def weighted_mean(x: Column, w: Column) -> Column:
    """Rows with a missing value are left out; a missing weight on a used row gives NULL."""
    unweighted = F.count_if(x.isNotNull() & w.isNull()) == 0
    used = F.when(x.isNotNull(), w)
    return F.when(unweighted, F.try_divide(F.sum(x * w), F.sum(used)))


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def ratio(a: Column, b: Column) -> Column:
    """Division where a zero denominator gives NULL (no infinities in the data model)."""
    return F.try_divide(a, b)


def floor_at(x: Column, low) -> Column:
    """Clamp from below; a missing value stays missing."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def cap_at(x: Column, high) -> Column:
    """Clamp from above; a missing value stays missing."""
    return F.when(x > high, F.lit(high)).otherwise(x)


def null_above(x: Column, high) -> Column:
    return F.when(x <= high, x)


def null_outside(x: Column, low, high) -> Column:
    return F.when((x >= low) & (x <= high), x)


def sentinel_to_null(x: Column, *codes) -> Column:
    return F.when(x.isin(*codes), F.lit(None)).otherwise(x)


def in_set(x: Column, values) -> Column:
    """Membership that is never unknown: a missing value is simply not a member."""
    return F.coalesce(x.isin(*values), F.lit(False))
