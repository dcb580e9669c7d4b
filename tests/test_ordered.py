"""Positions, histories, blocks and indicators against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from tickloom.operators.history import validity_intervals, version_history
from tickloom.operators.indicators import moving_indicators
from tickloom.operators.ordered import number_rows, with_halo

DAY0 = dt.datetime(2020, 1, 1)


def series(spark, lengths, step_days=9, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"T{t}", DAY0 + dt.timedelta(days=step_days * i), Decimal(rng.randint(100, 9999)) / 100)
        for t, n in enumerate(lengths)
        for i in range(n)
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "ticker string, time timestamp, close decimal(20,2)").repartition(5)


@pytest.mark.parametrize("ranges", [None, 3, 40])
def test_positions_match_a_plain_ranking(spark, ranges):
    rows, df = series(spark, [200, 3, 1])
    out = number_rows(df, ["ticker"], ["time"], ranges=ranges).collect()
    expected = defaultdict(list)
    for ticker, time, _ in rows:
        expected[ticker].append(time)
    assert {(r.ticker, r.time): r.position for r in out} == {
        (t, time): i + 1 for t, times in expected.items() for i, time in enumerate(sorted(times))
    }


@pytest.mark.parametrize("ranges", [None, 7])
def test_two_level_order(spark, ranges):
    rows = [(k, 1, i) for k in "AB" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, day int, id int").repartition(4)
    out = number_rows(df, ["k"], ["day", "id"], ranges=ranges).collect()
    assert len(out) == 100 and all(r.position == r.id + 1 for r in out)


def test_rows_are_windowed_by_range(spark):
    _, df = series(spark, [50])
    plan = plan_of(version_history(df, ["ticker"], "time", ["close"], ranges=4), "simple")
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert len(windows) == 1 and "_range" in windows[0].split("ASC")[0]
    # Per key only the rows of its cuts are ordered, never the rows themselves.
    assert all("_rows" in line for line in plan.splitlines() if "Window [" in line and line not in windows)


@pytest.mark.parametrize("ranges", [None, 5])
def test_null_keys_and_null_times(spark, ranges):
    days = [None, None, DAY0, DAY0 + dt.timedelta(days=1)]
    df = spark.createDataFrame([(k, d, i) for k in ("A", None) for i, d in enumerate(days)], "k string, t timestamp, id int")
    out = validity_intervals(df, ["k"], "t", ["id"], ranges=ranges).collect()
    for key in ("A", None):
        rows = sorted((r for r in out if r.k == key), key=lambda r: r.id)
        assert [r.version for r in rows] == [1, 2, 3, 4]
        assert [r.valid_to for r in rows] == [None, days[2], days[3], None]


@pytest.mark.parametrize("ranges", [None, 5])
def test_versions_break_ties(spark, ranges):
    df = spark.createDataFrame(
        [("A", DAY0, 2), ("A", DAY0, 1), ("A", DAY0 - dt.timedelta(days=400), 9)], "ticker string, created_at timestamp, id int"
    )
    out = {r.id: r.version for r in version_history(df, ["ticker"], "created_at", ["id"], ranges=ranges).collect()}
    assert out == {9: 1, 1: 2, 2: 3}


@pytest.mark.parametrize("ranges", [None, 2, 9])
def test_validity_intervals_cross_chunks(spark, ranges):
    days = [0, 1, 40, 400, 401]
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=d)) for d in days] + [("B", DAY0)], "ticker string, as_of timestamp")
    out = sorted(validity_intervals(df, ["ticker"], "as_of", ranges=ranges).collect())
    a = [r for r in out if r.ticker == "A"]
    assert [r.version for r in a] == [1, 2, 3, 4, 5]
    assert [r.valid_to for r in a[:-1]] == [r.as_of for r in a[1:]]
    assert [r.is_current for r in a] == [False] * 4 + [True] and a[-1].valid_to is None
    assert [(r.version, r.is_current) for r in out if r.ticker == "B"] == [(1, True)]


def test_halo_repeats_only_the_rows_the_next_block_needs(spark):
    df = spark.range(1, 26).withColumnRenamed("id", "position")
    out = with_halo(df, "position", 10, 3).collect()
    blocks = defaultdict(list)
    for r in out:
        blocks[r._block].append((r.position, r._own))
    assert sorted(blocks[1]) == [(8, False), (9, False), (10, False)] + [(i, True) for i in range(11, 21)]
    assert sum(r._own for r in out) == 25
    with pytest.raises(ValueError):
        with_halo(df, "position", 2, 3)


def brute_force(closes, rsi, sma):
    out = []
    for i in range(len(closes)):
        mean = sum(closes[i - sma + 1 : i + 1]) / sma if i + 1 >= sma else None
        strength = None
        if i >= rsi:
            moves = [closes[j] - closes[j - 1] for j in range(i - rsi + 1, i + 1)]
            gain, loss = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
            strength = 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + float(gain) / float(loss))
        out.append((strength, None if mean is None else float(mean)))
    return out


@pytest.mark.parametrize("block_rows,ranges", [(1, None), (16, 9), (8192, 4), (8192, None)])
def test_indicators_match_brute_force_whatever_the_block(spark, block_rows, ranges):
    rows, df = series(spark, [120, 14, 15, 2])
    out = {(r.ticker, r.time): (r.rsi_14, r.sma_20) for r in moving_indicators(df, (20,), (14,), block_rows=block_rows, ranges=ranges).collect()}
    assert len(out) == len(rows)
    by_ticker = defaultdict(list)
    for ticker, time, close in rows:
        by_ticker[ticker].append((time, close))
    for ticker, points in by_ticker.items():
        expected = brute_force([c for _, c in points], 14, 20)
        for (time, _), (strength, mean) in zip(points, expected):
            got = out[ticker, time]
            assert got[0] == pytest.approx(strength) if strength is not None else got[0] is None
            assert got[1] == pytest.approx(mean) if mean is not None else got[1] is None


def test_daily_series_need_one_window_per_ticker(spark):
    _, df = series(spark, [30, 5])
    daily = moving_indicators(df, (5,), (3,), one_per_day=True)
    assert plan_of(daily, "simple").count("Exchange hashpartitioning") == 1
    assert sorted(map(str, daily.collect())) == sorted(map(str, moving_indicators(df, (5,), (3,), ranges=4).collect()))


def test_rsi_is_100_without_losses(spark):
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=i), Decimal(i)) for i in range(5)], "ticker string, time timestamp, close decimal(20,2)")
    out = sorted(moving_indicators(df, (10,), (3,)).collect())
    assert [r.rsi_3 for r in out] == [None, None, None, 100.0, 100.0]
    assert all(r.sma_10 is None for r in out)
