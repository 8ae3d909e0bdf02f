"""Counters in 256-bit fixed point: whole numbers modulo 2 ** 256 whose last 128 bits are the fraction.

Such a counter, as pools keep for their fees, is larger than any numeric type and may wrap around. It comes as text of
up to 64 hexadecimal digits and is taken apart into eight limbs of 32 bits in longs, the lowest first. Differences are taken
limb by limb with a borrow; the last borrow is dropped, which is what makes a difference right across the wrap. Only
the result is scaled, once, to a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS, BITS = 8, 32
FRACTION = 128


def limbs_of(hexadecimal: Column | str) -> Column:
    """The limbs of a number in hexadecimal digits, with or without ``0x``; NULL for what is none."""
    text = F.lower(F.col(hexadecimal) if isinstance(hexadecimal, str) else hexadecimal)
    digits = F.regexp_replace(text, "^0x", "")
    whole = F.lpad(digits, 2 * BITS, "0")
    parts = [F.conv(F.substring(whole, 2 * BITS - 8 * k - 7, 8), 16, 10).cast("long") for k in range(LIMBS)]
    return F.when(digits.rlike("^[0-9a-f]{1,64}$"), F.array(*parts))


def _carried(raw: Column) -> Column:
    """Limbs brought below 2 ** BITS; what leaves the last one is dropped."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("limbs"))

    def step(state: Column, limb: Column) -> Column:
        total = state["carry"] + limb
        return F.struct(
            F.shiftright(total, BITS).alias("carry"),
            F.concat(state["limbs"], F.array(total.bitwiseAND(F.lit(2**BITS - 1)))).alias("limbs"),
        )

    return F.aggregate(raw, start, step, lambda state: state["limbs"])


def difference(a: Column, b: Column) -> Column:
    """``a - b`` modulo 2 ** 256."""
    return _carried(F.zip_with(a, b, lambda x, y: x - y))


def total(limbs: Column) -> Column:
    """Aggregate: the sum modulo 2 ** 256 of up to 2 ** 31 numbers; NULL if there is none."""
    sums = [F.sum(F.get(limbs, F.lit(k))) for k in range(LIMBS)]
    return F.when(sums[0].isNotNull(), _carried(F.array(*sums)))


def to_double(limbs: Column, fraction: int = FRACTION) -> Column:
    """The number as a double, its last ``fraction`` bits behind the point, off by at most one rounding of its limbs."""
    # from the lowest limb up, so that small ones are not lost one by one against large ones
    scaled = [F.get(limbs, F.lit(k)).cast("double") * 2.0 ** (BITS * k - fraction) for k in range(LIMBS)]
    whole = scaled[0]
    for part in scaled[1:]:
        whole = whole + part
    return whole
