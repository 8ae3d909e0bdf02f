"""Top-k by one measure, per group, or by either of several measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(
    df: DataFrame, by: str, k: int, tiebreak: Sequence[str], rank: str | None = "rank"
) -> DataFrame:
    """The ``k`` rows with the largest ``by``; NULLs last, ties by ``tiebreak``.

    Every task keeps its own ``k`` rows, so only those meet in the final task.
    """
    order = [F.desc_nulls_last(by), *[F.asc(c) for c in tiebreak]]
    best = df.orderBy(*order).limit(k)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def topk_per_group(
    df: DataFrame, group: Sequence[str], by: str, k: int, tiebreak: Sequence[str], rank: str = "rank"
) -> DataFrame:
    """The ``k`` rows with the largest ``by`` of each group.

    Spark cuts each group to ``k`` rows per task before the shuffle, so a hot group
    does not collect in one task.
    """
    order = [F.desc_nulls_last(by), *[F.asc(c) for c in tiebreak]]
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def _descending(by: str) -> Column:
    """A number whose ascending order is ``by`` descending with NULLs last.

    NaN is the largest double to Spark, so it stands for NULL; a NaN measure goes first.
    """
    x = F.col(by).cast("double")
    return F.when(x.isNull(), float("nan")).when(F.isnan(x), float("-inf")).otherwise(-x)


def _place_slice(place: Column) -> Column:
    """A whole number that never decreases with a place, and takes a bounded number of values."""
    size = F.floor(F.log2(F.abs(place)) * 64).cast("int")
    return (
        F.when(F.isnan(place), F.lit(2_000_000))
        .when(place == float("inf"), F.lit(1_000_000))
        .when(place == float("-inf"), F.lit(-1_000_000))
        .when(place > 0, size + 100_000)
        .when(place < 0, -size - 100_000)
        .otherwise(F.lit(0))
    )


def topk_any(df: DataFrame, ranks: dict[str, str], k: int, tiebreak: Sequence[str]) -> DataFrame:
    """Rows that are among the top ``k`` by *any* of several measures, with every exact rank.

    ``ranks`` maps a rank column to its measure; ``tiebreak`` must identify a row. A measure that
    is a sum must be exact, since a row is compared with itself over several passes. Only these
    columns come back; look further columns up for the few rows of the result. They are dealt out once by
    ``tiebreak``, and the passes below share that exchange, so ``df`` itself is evaluated once.

    At most ``k`` rows per measure can qualify, and those come from per-task top-k. Their rank
    in the *other* measures may be anything, and numbering all rows in one task to learn it
    does not scale. Instead rows are counted per slice of the measure (map-side). The few slices
    that hold a qualifying row are broadcast, one row each with its sorted marks; a row there is
    counted in the gap between marks where it sorts. Every row stays one row, however many marks
    its slice has, and a qualifying row is told from the others by its key, not by its value.
    """
    names = list(ranks)
    keyed = list(dict.fromkeys([*tiebreak, *ranks.values()]))
    slim = df.select(*keyed).repartition(F.xxhash64(*tiebreak))
    places = [_descending(ranks[name]) for name in names]
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)]).alias("tie")
    winners = reduce(
        DataFrame.union, [slim.orderBy(place, tie).limit(k) for place in places]
    ).distinct()

    def sides(rows: DataFrame, *extra: Column) -> DataFrame:
        """One row per measure: which, in which slice, and where."""
        each = [
            F.struct(
                F.lit(i).alias("side"), _place_slice(place).alias("slice"), place.alias("at"), tie, *extra
            )
            for i, place in enumerate(places)
        ]
        return rows.select(F.inline(F.array(*each)))

    marks = (
        sides(winners, F.struct(*keyed).alias("row"))
        .groupBy("side", "slice")
        .agg(F.array_sort(F.collect_list(F.struct("at", "tie", "row"))).alias("marks"))
    )
    here = F.struct("at", "tie")

    def not_after(mark: Column) -> Column:
        return (mark["tie"] == F.col("tie")) | (F.struct(mark["at"], mark["tie"]) <= here)

    gap = F.coalesce(F.size(F.filter("marks", not_after)), F.lit(0))
    counted = (
        sides(slim)
        .join(F.broadcast(marks), ["side", "slice"], "left")
        .groupBy("side", "slice", F.when(F.col("marks").isNull(), 0).otherwise(gap).alias("gap"))
        .agg(F.count("*").alias("n"))
    )
    in_order = Window.partitionBy("side").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        counted.groupBy("side", "slice")
        .agg(F.sum("n").alias("in_slice"), F.collect_list(F.struct("gap", "n")).alias("gaps"))
        .withColumn("earlier", F.coalesce(F.sum("in_slice").over(in_order), F.lit(0)))
    )
    ahead = F.aggregate(
        F.filter("gaps", lambda g: g["gap"] <= F.col("number")),
        F.lit(0).cast("long"),
        lambda total, g: total + g["n"],
    )
    placed = (
        marks.select("side", "slice", F.posexplode("marks").alias("number", "mark"))
        .join(slices, ["side", "slice"])
        .select("side", F.col("mark.row").alias("row"), (F.col("earlier") + ahead + 1).alias("rank"))
    )
    return placed.groupBy(*[F.col(f"row.{c}").alias(c) for c in keyed]).agg(
        *[F.max(F.when(F.col("side") == i, F.col("rank"))).alias(name) for i, name in enumerate(names)]
    )
