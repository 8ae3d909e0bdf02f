"""Shares of a group total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import salted_join


def share_of_total(
    df: DataFrame,
    keys: Sequence[str],
    shares: dict[str, str],
    spread: Sequence[str] = (),
) -> DataFrame:
    """Add each value divided by its group total.

    ``shares`` maps output names to values. Without ``spread`` the total is a window,
    for groups of a few rows each (such as one row per class). With ``spread``, columns
    that vary within a group, the totals are aggregated and joined back in salted parts.
    """
    if not spread:
        group = Window.partitionBy(*keys)
        return df.withColumns(
            {out: F.try_divide(F.col(v), F.sum(v).over(group)) for out, v in shares.items()}
        )
    names = {v: f"__total_{i}" for i, v in enumerate(dict.fromkeys(shares.values()))}
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(t) for v, t in names.items()])
    return (
        salted_join(df, totals, keys, spread)
        .withColumns({out: F.try_divide(F.col(v), F.col(names[v])) for out, v in shares.items()})
        .drop(*names.values())
    )
