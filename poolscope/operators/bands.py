"""Liquidity covering each price bound, and the central band of a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact, loose


def price_slice(price: str, per_octave: int = 64) -> Column:
    """A slice number that never decreases with the price.

    Slices depend on the price alone, so they need no pass over the data, and even the
    full range of doubles has a bounded number of them.
    """
    x = F.col(price)
    return (
        F.when(x <= 0, F.lit(-1_000_000))
        .when(F.isnan(x) | (x == float("inf")), F.lit(1_000_000))
        .otherwise(F.floor(F.log2(x) * per_octave).cast("int"))
    )


def liquidity_at_bounds(
    bands: DataFrame,
    keys: Sequence[str],
    lower: str = "price_lower_1_0",
    upper: str = "price_upper_1_0",
    liquidity: str = "avg_liquidity",
    bound: str = "price_bound_1_0",
) -> DataFrame:
    """For every distinct band edge of a key, the liquidity of all bands that contain it.

    Also gives the running total of that liquidity by rising edge (``liquidity_below``,
    the edge included) and its total over the key (``total_liquidity``).

    A sweep: a band starts at its lower edge and ends just after its upper edge, so the
    liquidity at an edge is what started up to and including it minus what ended strictly
    before it. No band is ever paired with an edge. A key's edges are swept slice by slice;
    only one summary row per slice meets in a task, to carry totals from slice to slice.
    """
    keys = list(keys)
    amount = F.when(F.col(lower) <= F.col(upper), F.col(liquidity)).otherwise(0.0)
    # a small band next to a huge one must not vanish when sums are subtracted
    amount = F.coalesce(amount, F.lit(0.0))
    parts = {"exact": exact(amount), "loose": loose(amount)}
    zero = {"exact": exact(F.lit(0)), "loose": F.lit(0.0)}

    def edge(at: str, up: bool) -> Column:
        columns = [F.col(at).alias("at")]
        for name, part in parts.items():
            nothing = zero[name]
            columns += [
                (part if up else nothing).alias(f"up_{name}"),
                (nothing if up else part).alias(f"down_{name}"),
            ]
        return F.struct(*columns)

    sums = [F.sum(f"__e.{side}_{name}").alias(f"__{side}_{name}") for name in parts for side in ("up", "down")]
    edges = (
        bands.select(*keys, F.explode(F.array(edge(lower, True), edge(upper, False))).alias("__e"))
        .groupBy(*keys, F.col("__e.at").alias(bound))
        .agg(*sums)
        .filter(F.col(bound).isNotNull())
        .withColumn("__slice", price_slice(bound))
    )

    def whole(prefix: str) -> Column:
        """The two parts of a sum put together."""
        return F.col(f"{prefix}_exact").cast("double") + F.col(f"{prefix}_loose")

    in_slice = Window.partitionBy(*keys, "__slice").orderBy(bound)
    swept = edges.withColumns(
        {
            f"__local_{name}": F.sum(f"__up_{name}").over(in_slice)
            - (F.sum(f"__down_{name}").over(in_slice) - F.col(f"__down_{name}"))
            for name in parts
        }
    )

    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(f"__{side}_{name}").alias(f"__{side}_{name}") for name in parts for side in ("up", "down")]
    carried = {
        f"__carried_{name}": F.coalesce(
            F.sum(f"__up_{name}").over(earlier) - F.sum(f"__down_{name}").over(earlier),
            zero[name],
        )
        for name in parts
    }
    slices = (
        swept.groupBy(*keys, "__slice")
        .agg(*totals, F.sum(whole("__local")).alias("__local"), F.count("*").alias("__n"))
        .withColumns(carried)
        # every edge of the slice also lies in the bands carried into it
        .withColumn("__sum", F.col("__local") + F.col("__n") * whole("__carried"))
        .select(
            *keys,
            "__slice",
            *carried,
            F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)).alias("__before"),
            F.sum("__sum").over(of_key).alias("total_liquidity"),
        )
    )

    here = [F.col(f"__carried_{name}") + F.col(f"__local_{name}") for name in parts]
    return (
        swept.join(slices, [*keys, "__slice"])
        .withColumn("bound_liquidity", here[0].cast("double") + here[1])
        .withColumn("liquidity_below", F.col("__before") + F.sum("bound_liquidity").over(in_slice))
        .select(*keys, bound, "bound_liquidity", "liquidity_below", "total_liquidity")
    )


def central_band(
    bounds: DataFrame, keys: Sequence[str], trim: float = 0.1, bound: str = "price_bound_1_0"
) -> DataFrame:
    """The price band left after cutting ``trim`` of the liquidity at either end.

    Keeps the bounds whose cumulative share is at least ``trim`` both from below and from
    above. The reciprocals keep their order of computation: the one called ``min`` is the
    reciprocal of the smallest bound, hence the larger number.
    """
    total, below = F.col("total_liquidity"), F.col("liquidity_below")
    above = total - below + F.col("bound_liquidity")
    return (
        bounds.filter((F.try_divide(below, total) >= trim) & (F.try_divide(above, total) >= trim))
        .groupBy(*keys)
        .agg(F.min(bound).alias("price_bound_1_0_min"), F.max(bound).alias("price_bound_1_0_max"))
        .withColumn("price_bound_0_1_min", F.try_divide(F.lit(1.0), F.col("price_bound_1_0_min")))
        .withColumn("price_bound_0_1_max", F.try_divide(F.lit(1.0), F.col("price_bound_1_0_max")))
    )
