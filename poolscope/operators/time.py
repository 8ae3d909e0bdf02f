"""Day buckets, lookbacks relative to an explicit ``as_of`` date, and day spines."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(day: date | str) -> date:
    return date.fromisoformat(day) if isinstance(day, str) else day


def timestamp(text: date | str) -> Column:
    """A zone-less timestamp literal; folds to a constant, so scans can push it down."""
    return F.lit(str(text)).cast("timestamp_ntz")


def hour_of(ts: str) -> Column:
    """The start of the hour of a zone-less timestamp, without passing through the session's zone."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def _until_end_of(ts: str, as_of: date) -> Column:
    return F.col(ts) < timestamp(as_of + timedelta(days=1))


def since(df: DataFrame, ts: str, as_of: date | str, lookback: str, strict: bool = False) -> DataFrame:
    """Rows from ``lookback`` (an interval such as ``6 months``) before ``as_of`` to its end."""
    day = as_date(as_of)
    start = timestamp(day) - F.expr(f"INTERVAL {lookback}")
    first = F.col(ts) > start if strict else F.col(ts) >= start
    return df.filter(first & _until_end_of(ts, day))


def since_days(df: DataFrame, ts: str, as_of: date | str, n: int) -> DataFrame:
    return since(df, ts, as_of, f"{n} days")


def since_months(df: DataFrame, ts: str, as_of: date | str, n: int) -> DataFrame:
    return since(df, ts, as_of, f"{n} months", strict=True)


def on_day(df: DataFrame, ts: str, day: date | str) -> DataFrame:
    """Rows of one day, as a half-open range on the raw column so that it is pushed down."""
    day = as_date(day)
    return df.filter((F.col(ts) >= timestamp(day)) & _until_end_of(ts, day))


def date_spine(
    entities: DataFrame, first_day: str, start: date | str, as_of: date | str, out: str = "day"
) -> DataFrame:
    """One row per entity and day from the later of ``first_day`` and ``start`` to ``as_of``."""
    last = F.lit(as_date(as_of))
    first = F.greatest(F.col(first_day), F.lit(as_date(start)))
    # The range condition stays inside the expression: an optimizer that moves the
    # filter must not make ``sequence`` see a start after its stop.
    days = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return entities.withColumn(out, F.explode(days))


def expand_days(
    intervals: DataFrame,
    first: str,
    until: str,
    lo: date | str,
    hi: date | str,
    out: str = "day",
) -> DataFrame:
    """One row per day of each half-open interval ``[first, until)`` cut to ``[lo, hi]``.

    A NULL ``until`` means the interval is still open.
    """
    start = F.greatest(F.col(first), F.lit(as_date(lo)))
    end = F.least(F.coalesce(F.date_sub(F.col(until), 1), F.lit(as_date(hi))), F.lit(as_date(hi)))
    days = F.when(start <= end, F.sequence(start, F.greatest(start, end)))
    return intervals.withColumn(out, F.explode(days)).drop(first, until)
