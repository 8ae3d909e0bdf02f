"""Row-based rolling measures, null-skipping differences and running totals.

Window groups here are series with one row per key and day (or per distinct
value), produced by an aggregation. Where a series can still be large, it is cut
into slices and the slices' totals are carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exact import EXACT, LIMBS, add_double


def rolling_rows(
    df: DataFrame,
    measures: dict[str, tuple[str, Callable[[str], Column]]],
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
) -> DataFrame:
    """Add aggregates over the current and the ``n - 1`` preceding rows of each key.

    ``measures`` maps an output name to (value column, aggregate function).
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
    return df.withColumns({out: agg(value).over(frame) for out, (value, agg) in measures.items()})


def rolling_rows_global(
    df: DataFrame,
    value: str,
    bucket: str,
    order: str,
    n: int,
    out: str,
    agg: Callable[[str], Column] = F.sum,
    block: int = 65536,
    slice_by: Column | None = None,
) -> DataFrame:
    """``rolling_rows`` over one total order (``bucket``, ``order``) without a one-task window.

    Rows are numbered within their slice of a bucket and offset by the counts of the slices
    before it, cut into blocks of consecutive numbers, and the last ``n - 1`` rows of a block
    are copied into the next one so that each block can be windowed alone. Only the slice
    counts meet in one task. ``slice_by`` cuts large buckets; it must not decrease with
    ``order`` within a bucket, must not be NULL, and must have a bounded number of values.
    (``bucket``, ``order``) must be unique.
    """
    if n > block:
        raise ValueError("a block must hold a whole frame")
    df = df.withColumn("__slice", F.lit(0) if slice_by is None else slice_by)
    before = Window.orderBy(bucket, "__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(bucket, "__slice")
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    in_slice = Window.partitionBy(bucket, "__slice").orderBy(order)
    position = F.col("__offset") + F.row_number().over(in_slice) - 1
    home = F.floor(F.col("__position") / block)
    in_tail = F.col("__position") % block >= block - (n - 1)
    copies = (
        df.join(offsets, [bucket, "__slice"])
        .withColumn("__position", position)
        .withColumn("__home", home)
        .withColumn(
            "__block",
            F.explode(
                F.when(in_tail, F.array(F.col("__home"), F.col("__home") + 1)).otherwise(
                    F.array(F.col("__home"))
                )
            ),
        )
    )
    frame = Window.partitionBy("__block").orderBy("__position").rowsBetween(-(n - 1), Window.currentRow)
    return (
        copies.withColumn(out, agg(value).over(frame))
        .filter(F.col("__block") == F.col("__home"))
        .drop("__slice", "__offset", "__position", "__home", "__block")
    )


def diff_prev_nonnull(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str
) -> DataFrame:
    """Difference to the latest earlier non-NULL value of the same key."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.col(value) - F.last(value, ignorenulls=True).over(earlier))


def running_positive(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    out: str,
    until: str | None = None,
) -> DataFrame:
    """Running total per key, keeping the rows where it is positive.

    ``value`` is a number or an exact sum (``functions.exact``); the total of exact sums is exact.
    With ``until``, each row also gets the next row's ``order`` value, so a kept row
    reads as a balance that holds over ``[order, until)``.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    if until is not None:
        df = df.withColumn(until, F.lead(order).over(series))
    if isinstance(df.schema[value].dataType, StructType):
        totals = running_exact(df, value, keys, order, out)
    else:
        totals = df.withColumn(out, F.sum(value).over(series))
    return totals.filter(F.col(out) > 0)


def running_exact(df: DataFrame, value: str, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Running exact totals: every exponent band of a key runs over all its rows, then they are put together.

    Amounts written in decimals have no band, so their rows stay one each.
    """
    none = F.lit(0)
    of_row = F.array_sort(F.filter(F.transform(f"{value}.parts", lambda p: p["j"]), lambda j: j != 0))
    of_key = F.array_sort(F.array_distinct(F.flatten(F.collect_set(of_row).over(Window.partitionBy(*keys)))))
    spread = df.withColumn("__bands", F.when(F.size(of_key) > 0, of_key).otherwise(F.array(none))).withColumn(
        "__j", F.explode("__bands")
    )
    own = F.get(F.filter(F.coalesce(f"{value}.parts", F.array()), lambda p: p["j"] == F.col("__j")), none)
    to_here = Window.partitionBy(*keys, "__j").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("__own", own)
    limbs = [F.sum(F.coalesce(f"__own.{a}", none.cast("long"))).over(to_here).alias(a) for a in LIMBS]
    ran = spread.withColumn("__part", F.struct(F.col("__j").alias("j"), *limbs)).withColumn(
        "__d", F.sum(F.coalesce(f"{value}.d", none.cast(EXACT))).over(to_here).cast(EXACT)
    )
    at_once = Window.partitionBy(*keys, order)
    whole = ran.withColumn("__total", F.struct(F.col("__d").alias("d"), F.collect_list("__part").over(at_once).alias("parts")))
    first = whole.filter(F.col("__j") == F.get("__bands", none))
    return add_double(first, "__total", out).drop("__bands", "__j", "__own", "__part", "__d", "__total")
