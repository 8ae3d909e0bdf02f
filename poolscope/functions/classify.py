"""Classification column builders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stable-coin symbols and the label vocabularies of the reports.
STABLE_SYMBOLS = ("USDC", "USDT", "DAI", "FEI", "EURS")
CLASS_LABELS = ("_stable_stable_", "_stable_other_", "_other_other_")
CLASS_LABELS_TITLE = ("Stable_Stable", "Stable_Unstable", "Unstable_Unstable")
CLASS_LABELS_RANKED = ("_Stable_Stable_", "_Stable_Unstable_", "_Unstable_Unstable_")
IN_RANGE, OUT_OF_RANGE = "_in_range_", "_out_of_range_"


def pairing_type(
    token0: str = "token0_symbol",
    token1: str = "token1_symbol",
    stables: Sequence[str] = STABLE_SYMBOLS,
    labels: Sequence[str] = CLASS_LABELS,
) -> Column:
    """Label a pool by how many of its two tokens are stable: both, one or none.

    A NULL symbol counts as not stable.
    """
    first = F.coalesce(F.col(token0).isin(*stables), F.lit(False))
    second = F.coalesce(F.col(token1).isin(*stables), F.lit(False))
    both, one, none = labels
    return F.when(first & second, both).when(first | second, one).otherwise(none)


def in_range_state(lower: str, upper: str, price: str) -> Column:
    """Whether ``price`` lies in the closed band; anything NULL is out of range."""
    return F.when(F.col(price).between(F.col(lower), F.col(upper)), IN_RANGE).otherwise(OUT_OF_RANGE)


def movement_label(
    open_state: str = "open_state",
    close_state: str = "close_state",
    open_liquidity: str = "open_liquidity",
    close_liquidity: str = "close_liquidity",
    increases: str = "token_increases",
    decreases: str = "token_decreases",
) -> Column:
    """What a provider did about liquidity that opened the day out of range.

    The first matching label wins, so their order matters.
    """
    opened_out = F.col(open_state) == OUT_OF_RANGE
    closed_in = F.col(close_state) == IN_RANGE
    closed_out = F.col(close_state) == OUT_OF_RANGE
    held = (F.col(open_liquidity) > 0) & (F.col(close_liquidity) > 0)
    added, removed = F.col(increases) > 0, F.col(decreases) > 0
    return (
        F.when(opened_out & closed_in & held & added & removed, "Updated_range")
        .when(opened_out & closed_in & held, "Floated_into_range")
        .when(opened_out & closed_out & held, "Still_out_of_range")
        .when(opened_out & closed_out & (F.col(open_liquidity) > 0) & removed, "Reduced_exposure")
        .otherwise("Other")
    )


def price_status(price0: str, price1: str) -> Column:
    """Which of a pool's two token prices are known."""
    has0, has1 = F.col(price0).isNotNull(), F.col(price1).isNotNull()
    return (
        F.when(has0 & has1, "both prices").when(has1, "price1").when(has0, "price0").otherwise("no prices")
    )


# The ages in days at which a row leaves a bucket, and the buckets' names.
RECENCY = ((30, "last_30"), (60, "31_60"), (90, "61_90"), (180, "91_180"), (360, "181_360"))
OLDER, UNDATED = "over_360", "_none_"


def recency_bucket(ts: str, as_of: date | str) -> Column:
    """How long before the start of ``as_of`` a row is, in steps of days; later rows count as the latest."""
    day = F.lit(str(as_of)).cast("date")
    label = F.when(F.col(ts).isNull(), UNDATED)
    for days, name in RECENCY:
        label = label.when(F.col(ts) >= F.date_sub(day, days).cast("timestamp_ntz"), name)
    return label.otherwise(OLDER)
