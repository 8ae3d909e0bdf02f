"""Exact sums: against fractions, in any partitioning, and where they decide which rows exist."""

from __future__ import annotations

import math
import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from poolscope.functions.exact import exact_totals
from poolscope.operators import balances

INF = float("inf")


def expected(values):
    """Decimals of 12 places and what they leave, added as fractions."""
    total = Fraction(0)
    for x in values:
        if x is not None and abs(x) < 1e15:
            places = Fraction(Decimal(repr(x)).quantize(Decimal("1e-12"), rounding=ROUND_HALF_UP))
            total += places + Fraction(x - float(places))
        elif x is not None:
            total += Fraction(x)
    return total


def groups():
    rng = random.Random(5)
    out = {
        "cancels": [1.1e16, 3300000000000003.0, -1.1e16, -3300000000000003.0],
        "cancels in pieces": [1e16] + [-1e14] * 100,
        "one and a quarter left": [1e16, -9999999999999998.0, -1.0, 0.25],
        "beyond doubles on the way": [1.7e308, 1.7e308, -1.7e308],
        "smallest": [5e-324, 5e-324],
        "nineteenth place": [1e-19] * 7,
        "large": [1e21, 1e21, 1e15, -1e15],
        "decimals": [0.1, 0.2, -0.3],
        "thirds": [1 / 3] * 3 + [-1.0],
        "nulls": [None, 2.5],
    }
    for n in range(40):
        size = rng.randint(1, 30)
        out[f"wide {n}"] = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-40, 40) for _ in range(size)]
        out[f"near {n}"] = [rng.choice([-1, 1]) * round(rng.random() * 10.0 ** rng.randint(0, 17), 2) for _ in range(size)]
    return out


def sums(df, parts):
    dealt = df.repartition(parts, F.rand(parts))
    return {r["k"]: r["s"] for r in exact_totals(dealt, ["k"], {"s": "x"}).collect()}


def test_equals_fractions_in_any_partitioning(spark):
    cases = groups()
    df = spark.createDataFrame([(k, x) for k, values in cases.items() for x in values], "k string, x double")
    got = sums(df, 1)
    for k, values in cases.items():
        total = expected(values)
        if total == 0:
            assert got[k] == 0.0, k
        else:
            assert (got[k] > 0) == (total > 0), k
            assert abs(Fraction(got[k]) - total) <= abs(total) * Fraction(1, 2**52) or abs(total) < Fraction(1, 10**300), k
    for parts in (3, 17):
        assert sums(df, parts) == got


def test_what_is_no_number(spark):
    df = spark.createDataFrame(
        [("nan", float("nan")), ("nan", 1.0), ("inf", INF), ("inf", -1e300), ("minus", -INF), ("both", INF), ("both", -INF),
         ("none", None)],
        "k string, x double",
    )
    got = sums(df, 2)
    assert math.isnan(got.pop("nan")) and math.isnan(got.pop("both"))
    assert got == {"inf": INF, "minus": -INF, "none": None}


def test_several_measures_and_keys_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 1e20), ("b", None, None), (None, 5.0, 0.5)], "k string, x double, y double")
    got = {(r["k"], r["s"], r["t"]) for r in exact_totals(df, ["k"], {"s": "x", "t": "y"}).collect()}
    assert got == {("a", 3.0, 1e20), ("b", None, None), (None, 5.0, 0.5)}


def actions(spark, rows):
    return spark.createDataFrame(
        [(datetime(2024, 1, d), f"{kind}_LIQUIDITY", "a", "p", "n", x, 1.0, 1.0) for d, kind, x in rows],
        "block_timestamp timestamp_ntz, action string, liquidity_provider string, pool_address string, pool_name string, "
        "liquidity_adjusted double, amount0_usd double, amount1_usd double",
    )


@pytest.mark.parametrize(
    "first, second", [(1.1e16, 3300000000000003.0), (1e21, 1e-19), (1 / 3, 1e15), (0.1, 0.2), (2.0**80, 2.0**-80)]
)
def test_a_provider_who_takes_everything_out_holds_nothing(spark, first, second):
    rows = [(1, "INCREASE", first), (2, "INCREASE", second), (4, "DECREASE", second), (5, "DECREASE", first)]
    held = balances.held_intervals(balances.net_liquidity_by_day(actions(spark, rows)), "2024-01-01", "2024-01-09")
    got = sorted((r["day"].day, r["until"].day, r["liquidity_adj"]) for r in held.collect())
    both = float(expected([first, second]))
    assert [(a, b) for a, b, _ in got] == [(1, 2), (2, 4), (4, 5)]
    assert [x for *_, x in got] == [first, pytest.approx(both, rel=3e-16), first]


def test_withdrawals_in_other_pieces_and_more_than_there_is(spark):
    rows = [(1, "INCREASE", 1e16)] + [(2, "DECREASE", 1e14)] * 100 + [(3, "INCREASE", 5e-20), (4, "DECREASE", 6e-20)]
    held = balances.held_intervals(balances.net_liquidity_by_day(actions(spark, rows)), "2024-01-01", "2024-01-09")
    got = sorted((r["day"], r["until"], r["liquidity_adj"]) for r in held.collect())
    assert got == [(date(2024, 1, 1), date(2024, 1, 2), 1e16), (date(2024, 1, 3), date(2024, 1, 4), 5e-20)]
