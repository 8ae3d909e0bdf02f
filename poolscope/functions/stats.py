"""Statistical column builders for use inside ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coef_var(value: str | Column) -> Column:
    """Coefficient of variation: sample standard deviation over mean."""
    return F.try_divide(F.stddev_samp(value), F.avg(value))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation that is NULL where it is undefined.

    The built-in raises a division error on a constant column in ANSI mode.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    cx, cy = F.when(both, F.col(x)), F.when(both, F.col(y))
    sx, sy = F.stddev_pop(cx), F.stddev_pop(cy)
    defined = (F.count(cx) > 1) & (sx > 0) & (sy > 0)
    return F.when(defined, F.try_divide(F.covar_pop(cx, cy), sx * sy))
