"""Joins whose keys may be hot: with a per-key summary, and of points with the intervals that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"


def _default_salts(df: DataFrame) -> int:
    # A third of all rows under one key, cut into partitions/3 parts, gives parts the size
    # of an average partition, however many partitions there are.
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3)


def salted_join(
    big: DataFrame,
    summary: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``summary`` with every key of ``on`` cut into salted parts.

    ``spread`` names columns of ``big`` that vary within one key. The summary is
    copied once per salt, so it must be an aggregate much smaller than ``big``.
    The salt also forces an exchange directly under the join on both sides, which
    is what adaptive execution needs to measure the summary (and broadcast it if
    it is small) or to split a part that is still too large.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"copying the summary would change a {how!r} join")
    n = salts or _default_salts(big)
    # never NULL, so that no filter is inferred on it that would make equal plans differ
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.lit(n).cast("long")), F.lit(0).cast("long"))
    salted = big.withColumn(_SALT, salt)
    copies = summary.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    )
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def _number(column: Column, kind: str) -> Column:
    """A place on the axis as a double: days, seconds, or the number itself."""
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return column.cast("timestamp").cast("double")
    return column.cast("double")


def outer_range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    lo: str,
    hi: str,
    on: Sequence[str] = (),
    width: float = 1.0,
    chunk: int = 100_000,
) -> DataFrame:
    """Full outer join of points with the intervals ``[lo, hi)`` that hold them, by keys ``on``.

    A NULL ``hi`` is open. What matches nothing comes back with NULLs on the other side: points in no
    interval, intervals without a point, rows with a NULL key, point or ``lo``. Repeated rows stay repeated.
    Both sides need column names of their own but for ``on``; a key comes from the side that has the row.

    The axis is cut into buckets of ``width`` (days, seconds or units). An interval meets a bucket only
    if the bucket has points, so an open one makes no more pieces than it has buckets to match. A bucket
    with more than ``chunk`` points or pieces of a key is a grid: its points are dealt into rows and its
    pieces into columns, and every cell is joined on its own. So each match is found in exactly one cell by
    an equality join with a condition, no loop over pairs of rows, and a cell holds at most about ``chunk``
    rows of a side. A row is unmatched if none of its cells matches it.
    """
    keys = list(on)
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    kind = dict(points.dtypes)[point]
    names = [f"__key_{i}" for i in range(max(1, len(keys)))]
    key = [*names, "__bucket"]

    def known(any_column: str) -> list[Column]:
        if keys:
            return [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
        # without a key all rows share one, in a form that stays an equality and makes no loop
        return [F.pmod(F.xxhash64(any_column), F.lit(1)).alias(names[0])]

    at = _number(F.col(point), kind)
    bucket = F.floor(at / width)
    usable = F.col(point).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    left = points.filter(usable).select(F.struct(*points.columns).alias("__left"), *known(point), bucket.alias("__bucket"))
    filled = left.groupBy(*key).agg(F.count("*").alias("__points"))

    start, end = _number(F.col(lo), kind), _number(F.col(hi), kind)
    real = F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(hi) > F.col(lo)))
    for k in keys:
        real = real & F.col(k).isNotNull()
    reach = filled.groupBy(*names).agg(F.min("__bucket").alias("__first"), F.max("__bucket").alias("__last"))
    held = intervals.filter(real).select(
        F.struct(*intervals.columns).alias("__right"), *known(lo), start.alias("__lo"), end.alias("__hi")
    )
    # one row per key; without keys one row in all
    spread = held.join(reach if keys else F.broadcast(reach), names)
    first = F.greatest(F.floor(F.col("__lo") / width), F.col("__first"))
    last = F.least(F.coalesce(F.floor(F.col("__hi") / width), F.col("__last")), F.col("__last"))
    pieces = spread.withColumn("__bucket", F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last))))).select(
        "__right", *key
    )

    size = pieces.groupBy(*key).agg(F.count("*").alias("__pieces")).join(filled, key)
    grid = size.select(
        *key, F.ceil(F.col("__points") / chunk).cast("int").alias("__rows"), F.ceil(F.col("__pieces") / chunk).cast("int").alias("__columns")
    )

    def dealt(side: DataFrame, what: str, own: str, other: str) -> DataFrame:
        """A row in one line of its bucket's grid, once for each cell of the line."""
        line = F.pmod(F.xxhash64(what), F.col(f"__{own}")).cast("int")
        cells = F.explode(F.sequence(F.lit(0), F.col(f"__{other}") - 1))
        return side.join(grid, key).withColumn(f"__{own}", line).withColumn(f"__{other}", cells)

    in_rows = dealt(left, "__left", "rows", "columns")
    in_columns = dealt(pieces, "__right", "columns", "rows")
    cell = [*key, "__rows", "__columns"]
    p, i = F.col(f"__left.{point}"), F.col("__right")
    inside = (p >= i[lo]) & (i[hi].isNull() | (p < i[hi]))
    a, b = in_rows.alias("a"), in_columns.alias("b")
    same = inside
    for c in cell:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    matches = a.join(b, same).select("__left", "__right")

    def lonely(rows: DataFrame, what: str, found: DataFrame) -> DataFrame:
        """Rows of a side that no match has, as often as they are there."""
        seen = found.select(what).distinct()
        whole = rows.select(F.struct(*rows.columns).alias(what)).alias("w")
        return whole.join(seen.alias("s"), F.col(f"w.{what}").eqNullSafe(F.col(f"s.{what}")), "left_anti")

    none_left = F.lit(None).cast(left.schema["__left"].dataType)
    none_right = F.lit(None).cast(held.schema["__right"].dataType)
    every = (
        matches.unionByName(lonely(points, "__left", matches).withColumn("__right", none_right))
        .unionByName(lonely(intervals, "__right", matches).withColumn("__left", none_left))
    )
    return every.select(
        *[F.coalesce(F.col("__left")[k], F.col("__right")[k]).alias(k) for k in keys],
        *[F.col("__left")[c].alias(c) for c in points.columns if c not in keys],
        *[F.col("__right")[c].alias(c) for c in intervals.columns if c not in keys],
    )
