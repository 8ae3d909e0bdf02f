"""Sums that are the same in any order of addition, for values of any size.

A sum of doubles changes in its last bits with the order in which tasks deliver their parts.
That is harmless in a reported figure, but not where the sum is compared with zero or with
another sum, or where large parts cancel. There a value has two parts that are summed each, both as
whole numbers:

* a decimal of 12 places, so that amounts written in decimals cancel as they were written;
* what the decimal leaves, as limbs: whole multiples of a power of two. A double has 53 bits, which lie
  in at most four neighbouring limbs of 24 bits, and its exponent says in which. The limbs of one
  exponent band are summed as longs, the bands of a key stay apart, and all are put together once, at
  the end, with carries from the lowest limb up.

Neither part rounds, so sums can be merged in any order and grouping, and a total is zero if and only if
what was added was taken out again, be it 1e-19 or 1e21. A value of 10^15 or more is a whole number and
eighths: the eighths go to the decimal, the rest to the limbs. Infinities and NaN are counted in a
band of their own. The total becomes a double at the end, by one rounding where one of the parts makes it up.

The limbs of a key and band hold 2^37 values and the decimal 26 digits before the point; beyond that
Spark reports an overflow instead of returning a wrong total.

``exact_sum`` is the form in one expression, whose second part is a double: exact for values below
10^15 of up to 12 places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,12)"
LARGEST = 1e15
LIMB, OFFSET = 24, 1152  # limb j holds whole multiples of 2 ** (LIMB * j - OFFSET)
ODD = -1  # the band that counts NaN, infinity and minus infinity
UNIT = OFFSET // LIMB  # the limb of ones
LIMBS = ("a0", "a1", "a2", "a3")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _small(x: Column) -> Column:
    return F.coalesce((F.abs(x) < LARGEST) & ~F.isnan(x), F.lit(False))


def exact(value: Column | str) -> Column:
    """The decimal part of a value; NULL for NULL."""
    x = _column(value).cast("double")
    return F.when(_small(x), x.try_cast(EXACT)).when(x.isNotNull(), F.lit(0).cast(EXACT))


def loose(value: Column | str) -> Column:
    """What the decimal part leaves of a value, as a double."""
    x = _column(value).cast("double")
    return F.when(_small(x), x - x.try_cast(EXACT).cast("double")).otherwise(x)


def exact_sum(value: Column | str) -> Column:
    """The sum as a double; NULL if there is no value."""
    return F.sum(exact(value)).cast("double") + F.sum(loose(value))


# --- limbs ------------------------------------------------------------------------


def _scaled(x: Column, exponent: Column) -> Column:
    """``x`` times a power of two, in two steps since the power alone may leave the range of doubles."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def add_parts(df: DataFrame, value: Column | str, out: str) -> DataFrame:
    """Add ``out``: a struct ``d, j, a0, a1, a2, a3`` of a value's decimal and limbs; NULL for NULL."""
    x, d, rest, j, units = (F.col(f"{out}__{c}") for c in ("x", "d", "rest", "j", "units"))
    zero = F.lit(0).cast(EXACT)
    finite = F.abs(x) < float("inf")
    decimal = (
        F.when(_small(x), F.coalesce(x.try_cast(EXACT), zero))
        # eighths and quarters; from 2 ** 53 on a double has none
        .when(F.abs(x) < 2.0**53, (x - x.cast("long").cast("double")).cast(EXACT))
        .otherwise(zero)
    )
    lowest = F.floor((F.floor(F.log2(F.abs(rest))) - 54 + OFFSET) / LIMB).cast("int")
    df = df.withColumn(f"{out}__x", _column(value).cast("double"))
    df = df.withColumn(f"{out}__d", decimal)
    df = df.withColumn(f"{out}__rest", F.when(finite, x - d.cast("double")).otherwise(0.0))
    df = df.withColumn(f"{out}__j", F.when(~finite, ODD).when(rest == 0, 0).otherwise(lowest))
    df = df.withColumn(f"{out}__units", F.when(j > 0, _scaled(F.abs(rest), OFFSET - LIMB * j)).otherwise(0.0))
    sign = F.when(rest < 0, -1).otherwise(1).cast("long")
    limbs: list[Column] = []
    left = units
    for k in (3, 2, 1, 0):
        limbs.insert(0, F.floor(left / 2.0 ** (LIMB * k)))
        left = left - limbs[0].cast("double") * 2.0 ** (LIMB * k)
    odd = [F.isnan(x), x == float("inf"), x == float("-inf"), F.lit(False)]
    fields = [
        F.when(j == ODD, flag.cast("long")).otherwise(sign * limb).alias(name)
        for name, limb, flag in zip(LIMBS, limbs, odd, strict=True)
    ]
    struct = F.when(x.isNotNull(), F.struct(d.alias("d"), j.alias("j"), *fields))
    return df.withColumn(out, struct).drop(*[f"{out}__{c}" for c in ("x", "d", "rest", "j", "units")])


def exact_groups(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column | str], plain: dict[str, Column | str] | None = None
) -> DataFrame:
    """Exact sums per key as structs ``d, parts``; ``plain`` sums of doubles may go beside a single one.

    Summed per key and exponent band before the shuffle; then the bands of a key, usually one and at
    most 90, are gathered. A sum without values is NULL, and so is a struct.
    """
    keys, plain = list(keys), plain or {}
    if plain and len(values) > 1:
        raise ValueError("plain sums go beside a single exact sum")
    df = df.withColumns({f"__plain_{name}": _column(value) for name, value in plain.items()})
    for i, value in enumerate(values.values()):
        df = add_parts(df, value, f"__part{i}")
    others = [f"__plain_{name}" for name in plain]
    if len(values) == 1:
        each = df.select(*keys, *others, F.lit(0).alias("__m"), F.col("__part0").alias("__p"))
    else:
        # a value that is NULL makes no row, unless all of a row are
        sides = [
            F.when(p.isNotNull(), F.struct(F.lit(i).alias("m"), p.alias("p")))
            for i, p in enumerate(F.col(f"__part{i}") for i in range(len(values)))
        ]
        known = F.filter(F.array(*sides), lambda side: side.isNotNull())
        each = df.select(*keys, F.explode_outer(known).alias("__s")).select(
            *keys, F.col("__s.m").alias("__m"), F.col("__s.p").alias("__p")
        )
    per_band = each.groupBy(*keys, "__m", F.col("__p.j").alias("__j")).agg(
        F.sum("__p.d").cast(EXACT).alias("__d"), *[F.sum(f"__p.{a}").alias(f"__{a}") for a in LIMBS],
        *[F.sum(name).alias(name) for name in others],
    )
    parts = F.struct(F.col("__j").alias("j"), *[F.col(f"__{a}").alias(a) for a in LIMBS])

    def total(i: int, name: str) -> Column:
        own = (F.col("__m") == i) & F.col("__j").isNotNull()
        d = F.sum(F.when(own, F.col("__d"))).cast(EXACT)
        return F.when(d.isNotNull(), F.struct(d.alias("d"), F.collect_list(F.when(own, parts)).alias("parts"))).alias(name)

    return per_band.groupBy(*keys).agg(
        *[total(i, name) for i, name in enumerate(values)], *[F.sum(f"__plain_{name}").alias(name) for name in plain]
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` under a name, so that an optimizer cannot copy it into every mention."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _carried(limbs: str) -> str:
    """SQL: limbs from the lowest on as digits below 2 ** LIMB, and the signed rest as one more."""
    digit = f"t & {2**LIMB - 1}L"
    step = _let("t", "s.c + x", f"named_struct('c', shiftright(t, {LIMB}), 'd', concat(s.d, array({digit})))")
    start = "named_struct('c', 0L, 'd', cast(array() as array<bigint>))"
    return f"aggregate(concat({limbs}, array(0L, 0L, 0L)), {start}, (s, x) -> {step}, s -> concat(s.d, array(s.c)))"


def add_double(df: DataFrame, total: str, out: str) -> DataFrame:
    """Add ``out``: the double of an exact total ``d, parts``.

    Limbs alone and a decimal alone are rounded once. Where both count, ten to the twelfth times the
    total is a whole number of limbs, which is put together before it is rounded and divided again.
    """
    d, parts = f"`{total}`.d", f"`{total}`.parts"
    is_live = f"p.j > 0 AND ({' OR '.join(f'p.{a} <> 0' for a in LIMBS)})"
    # the whole part of the decimal joins the ones, in two limbs' places
    whole = f"cast(floor({d}) as decimal(38,0))"
    upper = f"({whole} div {2 ** (2 * LIMB)})"
    lower = f"cast({whole} - cast({upper} as decimal(38,0)) * {2 ** (2 * LIMB)} as bigint)"
    cases = " ".join(f"WHEN {k} THEN p.a{k}" for k in range(4))
    sums = f"aggregate(live, 0L, (sum, p) -> sum + CASE k - p.j {cases} ELSE 0L END)"
    decimal = f"CASE WHEN both AND k = {UNIT} THEN {lower} WHEN both AND k = {UNIT + 2} THEN {upper} ELSE 0L END"
    lowest = "array_min(transform(live, p -> p.j))"
    highest = f"greatest(array_max(transform(live, p -> p.j)) + 3, {UNIT + 2})"
    raw = f"transform(sequence(low, {highest}), k -> {sums} + {decimal})"
    fraction = f"cast(pmod({d}, 1) * 1000000000000 as bigint)"

    def times(digits: str, added: str = "0L") -> str:
        """A million times the number, where the decimal counts."""
        product = f"transform({digits}, (x, i) -> x * 1000000L + CASE WHEN i + low = {UNIT} THEN {added} ELSE 0L END)"
        return f"CASE WHEN both THEN {_carried(product)} ELSE {digits} END"

    def digit(below: int) -> str:
        return f"CASE WHEN top >= {below} THEN digits[top - {below}] ELSE 0L END"

    base = f"{2**LIMB}L"
    high = f"cast(({digit(0)}) * {base} + ({digit(1)}) as double) * {float(2 ** (2 * LIMB))!r}D"
    rest = "CASE WHEN array_min(at) < top - 3 THEN 0.5D ELSE 0D END"
    low_part = f"cast(({digit(2)}) * {base} + ({digit(3)}) as double) + {rest}"
    power = f"({LIMB} * (low + top - 3) - {OFFSET})"
    half = f"floor({power} / 2)"
    value = f"sign * ({high} + ({low_part})) * pow(2D, {half}) * pow(2D, {power} - {half}) / CASE WHEN both THEN 1e12D ELSE 1D END"
    steps = [
        ("live", f"filter({parts}, p -> {is_live})"),
        ("both", f"{d} <> 0"),
        ("low", f"CASE WHEN both THEN least({lowest}, {UNIT}) ELSE {lowest} END"),
        ("plain", _carried(raw)),
        ("more", times("plain")),
        ("all", times("more", fraction)),
        ("sign", "CASE WHEN element_at(all, -1) < 0 THEN -1D ELSE 1D END"),
        ("digits", f"CASE WHEN sign < 0 THEN {_carried('transform(all, x -> -x)')} ELSE all END"),
        ("at", "filter(sequence(0, size(digits) - 1), i -> digits[i] <> 0)"),
        ("top", "array_max(at)"),
    ]
    limbs = f"CASE WHEN top IS NULL THEN 0D ELSE {value} END"
    for name, step in reversed(steps):
        limbs = _let(name, step, limbs)

    def counted(limb: str) -> str:
        return f"exists({parts}, p -> p.j = {ODD} AND p.{limb} > 0)"

    odd = (
        f"CASE WHEN {counted('a0')} OR ({counted('a1')} AND {counted('a2')}) THEN double('NaN') "
        f"WHEN {counted('a1')} THEN double('infinity') ELSE double('-infinity') END"
    )
    return df.withColumn(
        out,
        F.expr(
            f"CASE WHEN {d} IS NULL THEN NULL WHEN exists({parts}, p -> p.j = {ODD}) THEN {odd} "
            f"WHEN exists({parts}, p -> {is_live}) THEN {limbs} ELSE cast({d} as double) END"
        ),
    )


def exact_totals(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column | str], plain: dict[str, Column | str] | None = None
) -> DataFrame:
    """Sums per key as doubles, each exact until its last step; ``plain`` as in ``exact_groups``."""
    totals = exact_groups(df, keys, {f"__exact_{name}": value for name, value in values.items()}, plain)
    for name in values:
        totals = add_double(totals, f"__exact_{name}", name)
    return totals.select(*keys, *values, *(plain or {}))
