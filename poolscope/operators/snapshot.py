"""Picking states: first and last of a bucket, last values, first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ends(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The smallest and largest ``order`` of each key, one row each, flagged."""
    return (
        df.groupBy(*keys)
        .agg(F.min(order).alias("__min"), F.max(order).alias("__max"))
        .withColumn(order, F.explode(F.array_distinct(F.array("__min", "__max"))))
        .withColumn("is_first", F.col(order) == F.col("__min"))
        .withColumn("is_last", F.col(order) == F.col("__max"))
        .drop("__min", "__max")
    )


def flag_boundaries(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``is_first`` and ``is_last``: whether a row holds its key's first or last ``order``.

    Rows tied at a boundary are all flagged; rows with a NULL key never are. The ends
    come from a map-side aggregation and are looked up by (keys, ``order``), so a hot
    key spreads over its ``order`` values instead of filling one window group.
    """
    flagged = df.join(_ends(df, keys, order), [*keys, order], "left")
    return flagged.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_first", "is_last")}
    )


def boundary_rows(
    df: DataFrame, keys: Sequence[str], order: str, value: str, open_out: str, close_out: str
) -> DataFrame:
    """Opening and closing rows of each key with a positive ``value``.

    The boundary is found over all rows first; a boundary row without a positive value
    is then dropped, not replaced by its neighbour. ``open_out`` and ``close_out`` hold
    the value if the row is the opening or closing one, else 0.
    """
    kept = df.filter(F.col(value) > 0).join(_ends(df, keys, order), [*keys, order])
    return kept.withColumns(
        {
            open_out: F.when(F.col("is_first"), F.col(value)).otherwise(F.lit(0.0)),
            close_out: F.when(F.col("is_last"), F.col(value)).otherwise(F.lit(0.0)),
        }
    ).drop("is_first", "is_last")


def last_in_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], running: Column | None = None
) -> DataFrame:
    """The values of each key's last row by ``order``, NULL values included.

    One partial and one final aggregation; a hot key sends one row per map task.

    ``running`` takes the frame the other way, up to each row in turn as SQL does by default: one row per key and distinct
    values seen last. It is the column that cuts keys into slices, as ``running_last`` wants it.
    """
    if running is not None:
        return running_last(df.select(*dict.fromkeys([*keys, *order, *values])), keys, order, values, running).select(
            *keys, *values
        ).distinct()
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values])


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice_by: Column, ignore_nulls: bool = False
) -> DataFrame:
    """``df`` with each of ``values`` replaced by the last one up to the row, rows equal in ``order`` included.

    The frame SQL takes where none is written. A key is cut into the slices of ``slice_by``, which must not decrease with
    ``order``, must not be NULL and must put rows equal in ``order`` together. Each slice is read on its own, and
    what a slice ends with is carried on slice by slice, over one row each. So no window holds the raw
    rows of a key. Without ``ignore_nulls`` nothing is ever carried over, for a slice's rows have values of their own.
    """
    cut = df.withColumn("__slice", slice_by)
    here = Window.partitionBy(*keys, "__slice").orderBy(*order)
    read = cut.withColumns({f"__{v}": F.last(v, ignorenulls=ignore_nulls).over(here) for v in values})
    if not ignore_nulls:
        return read.drop("__slice", *values).withColumnsRenamed({f"__{v}": v for v in values}).select(*df.columns)
    place = F.struct(*order)
    latest = [F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(f"__end_{v}") for v in values]
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "__slice").agg(*latest).select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__at"),
        *[F.last(f"__end_{v}", ignorenulls=True).over(before).alias(f"__end_{v}") for v in values],
    )
    same = F.col("__slice") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    whole = read.join(carried, same, "left")
    kept = [F.coalesce(f"__{c}", f"__end_{c}").alias(c) if c in values else F.col(c) for c in df.columns]
    return whole.select(*kept)


def first_seen(df: DataFrame, key: str, ts: str, candidates: DataFrame | None = None) -> DataFrame:
    """Rows at each key's first ``ts``; all of them if several share it.

    ``candidates`` may be ``df`` already filtered for what the caller keeps: the first
    time is still found over all rows, but fewer rows are shuffled for the lookup.
    """
    first = df.groupBy(key).agg(F.min(ts).alias(ts))
    return (df if candidates is None else candidates).join(first, [key, ts])
