"""Bias-corrected moments, null-safe correlation and clipping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def skewness(c: str | Column) -> Column:
    """Sample skewness; 0 for a constant column, NULL below three values."""
    c = _col(c)
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.coalesce(F.skewness(c) * factor, F.lit(0.0)))


def kurtosis(c: str | Column) -> Column:
    """Sample excess kurtosis; 0 for a constant column, NULL below four values."""
    c = _col(c)
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, F.coalesce(factor * ((n + 1) * F.kurtosis(c) + 6), F.lit(0.0)))


def correlation(a: str | Column, b: str | Column, complete: bool = False) -> Column:
    """Pearson correlation over rows where both sides are present.

    A constant side gives NULL. With ``complete`` (no NULL in either column) the
    deviations are per column, so many pairs share them within one aggregate.
    """
    a, b = _col(a).cast("double"), _col(b).cast("double")
    if complete:
        spread = F.stddev_samp(a) * F.stddev_samp(b)
    else:
        spread = F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_samp(a, b), spread)


def clip(c: str | Column, low, high) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would drop it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def distribution_label(skew: Column) -> Column:
    return (
        F.when(skew.isNull(), "unknown")
        .when(F.abs(skew) < 0.5, "approximately_normal")
        .when(skew > 1.0, "right_skewed")
        .when(skew < -1.0, "left_skewed")
        .otherwise("moderately_skewed")
    )


def share(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double"))
