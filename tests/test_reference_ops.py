"""Range joins, 256-bit counters, running last values, distinct counts and end-point totals, by hand and by brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from poolscope.functions import fixed
from poolscope.operators import balances, flows, joins, snapshot

# --- full outer range join --------------------------------------------------------


def literal(points, intervals, keyed):
    out, hit = Counter(), set()
    for p in points:
        found = [
            i for i in intervals
            if p[1] is not None and i[1] is not None and i[1] <= p[1] and (i[2] is None or p[1] < i[2])
            and (not keyed or (p[0] is not None and p[0] == i[0]))
        ]
        hit |= {id(i) for i in found}
        for i in found or [(None,) * 4]:
            out[(p[0], p[1], p[2], *((i[1:]) if keyed else i))] += 1
    for i in intervals:
        if id(i) not in hit:
            out[((i[0], None, None, *i[1:]) if keyed else (None, None, None, *i))] += 1
    return out


def range_rows(seed, n):
    rng = random.Random(seed)

    def maybe(x):
        return None if rng.random() < 0.05 else x

    points = [(maybe(rng.choice("ab")), maybe(float(rng.randint(0, 60))), f"p{rng.randint(0, 40)}") for _ in range(n)]
    intervals = []
    for k in range(n // 3):
        lo = rng.randint(-10, 70)
        intervals.append((maybe(rng.choice("abc")), maybe(float(lo)), maybe(float(lo + rng.randint(-2, 25))), f"i{k}"))
    return points + points[:5], intervals + [(*i,) for i in intervals[:4]]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("width, chunk", [(1.0, 100_000), (7.0, 5), (1000.0, 20)])
def test_range_join_equals_all_pairs(spark, no_broadcast, keyed, width, chunk):
    points, intervals = range_rows(3, 120)
    a = spark.createDataFrame(points, "k string, at double, p string")
    b = spark.createDataFrame(intervals, f"{'k' if keyed else 'other'} string, lo double, hi double, i string")
    joined = joins.outer_range_join(a, b, "at", "lo", "hi", ["k"] if keyed else [], width, chunk)
    assert Counter(map(tuple, joined.collect())) == literal(points, intervals, keyed)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_range_join_splits_a_hot_bucket(spark, no_broadcast):
    """All points and intervals in one bucket: no cell gets more than its share of either side."""
    points = spark.range(4000).selectExpr("CAST(id % 10 AS DOUBLE) AS at", "id AS p")
    held = spark.range(300).selectExpr("0D AS lo", "5D AS hi", "id AS i")
    joined = joins.outer_range_join(points, held, "at", "lo", "hi", width=100, chunk=100)
    assert joined.filter("i IS NOT NULL AND p IS NOT NULL").count() == 2000 * 300
    assert joined.filter("i IS NULL").count() == 2000


def test_range_join_on_dates_and_empty_sides(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "day date")
    held = spark.createDataFrame([("a", date(2024, 1, 2), None), ("z", date(2024, 2, 1), None)], "who string, since date, until date")
    got = {tuple(r) for r in joins.outer_range_join(days, held, "day", "since", "until").collect()}
    d = [date(2024, 1, k) for k in range(4) if k] + [date(2024, 2, 1)]
    assert got == {(d[0], None, None, None), (d[1], "a", d[1], None), (d[2], "a", d[1], None), (None, "z", d[3], None)}
    assert joins.outer_range_join(days.limit(0), held, "day", "since", "until").count() == 2
    assert joins.outer_range_join(days, held.limit(0), "day", "since", "until").count() == 3


# --- 256-bit counters -------------------------------------------------------------

TOP = 2**256


def counters():
    rng = random.Random(9)
    special = [0, 1, 2**32 - 1, 2**32, 2**128, 2**128 - 1, TOP - 1, TOP - 2**128]
    return special + [rng.getrandbits(rng.randint(1, 256)) for _ in range(40)]


def test_differences_of_counters_wrap_around(spark):
    numbers = counters()
    pairs = [(f"{a:x}", f"0x{b:064X}", a, b) for a in numbers for b in numbers]
    df = spark.createDataFrame([(x, y, k) for k, (x, y, *_) in enumerate(pairs)], "a string, b string, k int")
    grown = fixed.difference(fixed.limbs_of("a"), fixed.limbs_of("b"))
    for r in df.select("k", grown.alias("limbs"), fixed.to_double(grown).alias("x")).collect():
        _, _, a, b = pairs[r["k"]]
        wanted = (a - b) % TOP
        assert sum(limb << (32 * i) for i, limb in enumerate(r["limbs"])) == wanted
        assert r["x"] == pytest.approx(wanted / 2**128, rel=1e-15)


def test_sums_of_counters(spark):
    numbers = counters()
    df = spark.createDataFrame([(f"{n:x}",) for n in numbers], "a string").repartition(5)
    limbs = df.agg(fixed.total(fixed.limbs_of("a")).alias("t")).first()["t"]
    assert sum(limb << (32 * i) for i, limb in enumerate(limbs)) == sum(numbers) % TOP
    assert df.limit(0).agg(fixed.total(fixed.limbs_of("a")).alias("t")).first()["t"] is None


def test_what_is_no_counter_is_null(spark):
    df = spark.createDataFrame([("",), ("xyz",), (None,), ("f" * 65,), ("-1",)], "a string")
    assert [r[0] for r in df.select(fixed.limbs_of("a")).collect()] == [None] * 5


# --- running last values ----------------------------------------------------------


@pytest.mark.parametrize("ignore", [True, False])
def test_running_last_equals_one_window(spark, ignore):
    from pyspark.sql import Window

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 300), rng.choice([None, None, float(k)]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v double, id int")
    # rows equal in time are peers, so the time and id order rows and the window is free of ties
    window = Window.partitionBy("k").orderBy("t", "id")
    wanted = df.withColumn("v", F.last("v", ignorenulls=ignore).over(window))
    got = snapshot.running_last(df, ["k"], ["t", "id"], ["v"], F.floor(F.col("t") / 7), ignore)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, wanted.collect()))


def test_running_last_reads_no_key_in_one_window(spark):
    df = spark.range(1000).selectExpr("'hot' AS k", "id AS t", "CAST(NULL AS DOUBLE) AS v")
    plan = snapshot.running_last(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / 10), True)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    raw = [w for w in windows if "__end_v" not in w]
    assert raw and all("__slice" in w.split("],")[1] for w in raw)


# --- distinct counts --------------------------------------------------------------


def test_distinct_counts_take_no_expand(spark):
    df = spark.createDataFrame(
        [("d", 1.0, 2.0, "t1", "u1"), ("d", 1.0, 2.0, "t1", "u2"), ("d", 3.0, None, None, "u2"), ("e", None, None, "t1", None)],
        "day string, amount double, usd double, tx string, who string",
    )
    totals = flows.flow_totals(df, {"day": "day"}, "amount", "usd", tx="tx", user="who", count_rows=True)
    got = sorted(tuple(r) for r in totals.collect())
    assert totals.columns == ["day", "token_amount", "amount_usd", "num_users", "dist_num_txs", "num_txs"]
    assert got == [("d", 5.0, 4.0, 2, 1, 2), ("e", None, None, 0, 1, 1)]
    assert "Expand" not in totals._jdf.queryExecution().executedPlan().toString()
    plain = flows.flow_totals(df, {"day": "day"}, "amount", "usd")
    assert sorted(tuple(r) for r in plain.collect()) == [("d", 5.0, 4.0), ("e", None, None)]


# --- totals from end points -------------------------------------------------------


def test_totals_from_end_points_equal_expanded_holdings(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        start = date(2024, 1, 1) + timedelta(days=rng.randint(-5, 25))
        until = rng.choice([None, start + timedelta(days=rng.randint(1, 12))])
        rows.append((f"lp{i}", rng.choice(["p", "q"]), "n", start, until, rng.choice([0.1, 0.7, 1e16, 1e-9, 3.25])))
    schema = "liquidity_provider string, pool_address string, pool_name string, day date, until date, liquidity_adj double"
    intervals = spark.createDataFrame(rows, schema)
    lo, hi = "2024-01-03", "2024-01-20"
    got = {(r["pool_address"], r["block_day"]): r["total_liquidity_adj"] for r in balances.held_totals(intervals, lo, hi).collect()}
    days = balances.daily_holdings(intervals, lo, hi)
    wanted = days.groupBy("pool_address", "block_day").agg(F.sum("liquidity_adj").alias("x")).collect()
    assert got.keys() == {(r["pool_address"], r["block_day"]) for r in wanted}
    for r in wanted:
        assert got[r["pool_address"], r["block_day"]] == pytest.approx(r["x"], rel=1e-12)


def test_totals_expand_no_holding(spark):
    schema = "liquidity_provider string, pool_address string, pool_name string, day date, until date, liquidity_adj double"
    intervals = spark.createDataFrame([("a", "p", "n", date(2024, 1, 1), None, 1.0)], schema)
    plan = balances.held_totals(intervals, "2024-01-01", "2024-12-31")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    expansions = [i for i, line in enumerate(lines) if "sequence(" in line and "Generate" in line]
    folds = [i for i, line in enumerate(lines) if "Aggregate" in line]
    assert expansions and max(expansions) < min(folds)


def test_what_ended_leaves_nothing_in_the_totals(spark):
    schema = "liquidity_provider string, pool_address string, pool_name string, day date, until date, liquidity_adj double"
    rows = [("a", "p", "n", date(2024, 1, 1), date(2024, 1, 3), 1e16), ("b", "p", "n", date(2024, 1, 2), None, 0.1)]
    totals = balances.held_totals(spark.createDataFrame(rows, schema), "2024-01-01", "2024-01-04")
    assert sorted((r["block_day"].day, r["total_liquidity_adj"]) for r in totals.collect()) == [(1, 1e16), (2, 1e16), (3, 0.1), (4, 0.1)]


def test_fee_growth_over_a_wrap(spark):
    from poolscope.operators.pool import fee_growth

    def state(day, hour, value):
        return ("p", datetime(2024, 1, day, hour), day * 100 + hour, f"{value % TOP:064x}")

    rows = [state(1, 1, -5 * 2**128), state(1, 9, -3 * 2**128), state(2, 3, 2**127), state(4, 1, 2**128)]
    df = spark.createDataFrame(rows, "pool_address string, block_timestamp timestamp_ntz, block_id long, fee_growth_global0_x128 string")
    got = sorted((r["block_day"].day, r["fee_growth"]) for r in fee_growth(df).collect())
    assert got == [(1, None), (2, 3.5), (4, 0.5)]
