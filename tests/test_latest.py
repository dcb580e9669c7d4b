"""One winner per key, keyed replace, published tables."""

from __future__ import annotations

import datetime as dt
import random
import re
import shutil
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plans import plan_of
from tickloom.functions.columns import fill_nulls
from tickloom.operators.latest import conform, keyed_replace, one_per_key
from tickloom.plans.warehouse import (
    append_company_history,
    append_indicators,
    appended_indicators,
    company_history,
    publish_calendar,
    publish_company_history,
    publish_indicators,
    short_term_indicators,
)
from tickloom.sinks.commits import CommitLog, ranges, without
from tickloom.sinks.tables import PARTITION, append_load, compact, expire, held, read_current, read_loads
from tickloom.specs import TABLES

ROWS = [("A", 1, s, f"v{s}") for s in range(5)] + [("B", 2, 1, "x"), ("B", 2, 1, "y"), (None, None, 0, None)]
SCHEMA = "ticker string, time int, stamp int, v string"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_newest_stamp_wins_then_the_rest_of_the_row(spark):
    out = one_per_key(spark.createDataFrame(ROWS, SCHEMA), ["ticker", "time"], ["stamp"])
    assert out.columns == ["ticker", "time", "stamp", "v"]
    assert tuples(out) == sorted([("A", 1, 4, "v4"), ("B", 2, 1, "y"), (None, None, 0, None)], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_result_does_not_depend_on_input_order(spark, seed):
    rows = ROWS * 3
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(1 + seed * 3)
    assert tuples(one_per_key(df, ["ticker", "time"], ["stamp"])) == tuples(
        one_per_key(spark.createDataFrame(ROWS, SCHEMA), ["ticker", "time"], ["stamp"])
    )


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 2), st.integers(-3, 3), st.sampled_from(["", "a", "b"])), min_size=1, max_size=30))
def test_against_brute_force(spark, rows):
    best = {}
    for ticker, time, stamp, v in rows:
        best[ticker, time] = max(best.get((ticker, time), (stamp, v)), (stamp, v))
    expected = sorted(((t, i, *sv) for (t, i), sv in best.items()), key=str)
    assert tuples(one_per_key(spark.createDataFrame(rows, SCHEMA), ["ticker", "time"], ["stamp"])) == expected


def test_keys_only_and_unorderable_columns(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "ticker string, time int")
    assert one_per_key(df, ["ticker", "time"]).count() == 2
    maps = spark.createDataFrame([("A", {"k": 1}), ("A", {"k": 2})], "ticker string, m map<string,int>")
    assert one_per_key(maps, ["ticker"]).collect()[0]["m"] == {"k": 2}


def test_null_keys_filled_first_collapse_to_one_row(spark):
    df = spark.createDataFrame([("A", None, 1), ("A", None, 2)], "ticker string, time timestamp, v int")
    out = one_per_key(fill_nulls(df), ["ticker", "time"]).collect()
    assert [tuple(r) for r in out] == [("A", dt.datetime(1970, 1, 1), 2)]


def test_duplicates_are_combined_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit("A").alias("ticker"), F.lit(1).alias("time"), "id")
    plan = plan_of(one_per_key(df, ["ticker", "time"]), "simple")
    assert plan.count("Exchange") == 1 and "partial_max" in plan


def test_keyed_replace_is_idempotent_and_later_loads_win(spark):
    first = spark.createDataFrame([("A", 1, 9), ("B", 1, 1)], "ticker string, time int, v int")
    second = spark.createDataFrame([("A", 1, 2), ("C", 1, 3)], "ticker string, time int, v int")
    once = keyed_replace([first, second], ["ticker", "time"], "load")
    assert tuples(once) == [("A", 1, 2), ("B", 1, 1), ("C", 1, 3)]
    assert tuples(keyed_replace([once, second, second], ["ticker", "time"], "load")) == tuples(once)


def test_loads_may_differ_in_columns(spark):
    a = spark.createDataFrame([("A", 1)], "ticker string, v int")
    b = spark.createDataFrame([("B", "x")], "ticker string, w string")
    assert tuples(keyed_replace([a, b], ["ticker"], "load")) == [("A", 1, None), ("B", None, "x")]


def test_conform_drops_adds_and_casts(spark):
    df = spark.createDataFrame([("VNM", "junk", 1.5)], "TICKER string, `index` string, pe double")
    out = conform(df, TABLES["fact_financial_ratio"].columns)
    assert out.columns == [n for n, _ in TABLES["fact_financial_ratio"].columns]
    row = out.collect()[0]
    assert row["ticker"] == "VNM" and row["pe"] == Decimal("1.5000") and row["ps"] is None


def _bars(spark, rows):
    return spark.createDataFrame(
        [(t, dt.datetime.fromisoformat(ts), dt.date.fromisoformat(ts[:10]), Decimal(p), Decimal(p), Decimal(p), Decimal(p), v)
         for t, ts, p, v in rows],
        "ticker string, time timestamp, date_id date, open decimal(20,2), high decimal(20,2), low decimal(20,2), close decimal(20,2), volume bigint",
    )


def test_published_table_replay_replace_and_compaction(spark, path):
    spec, target = TABLES["fact_daily_price"], path("fact")
    old = _bars(spark, [("A", "2024-01-31T00:00:00", "9", 1), ("A", "2024-02-01T00:00:00", "9", 1)])
    new = _bars(spark, [("A", "2024-02-01T00:00:00", "2", 5), ("B", "2024-02-02T00:00:00", "3", 1)])
    append_load(old, target, spec, 0)
    append_load(new, target, spec, 1)
    append_load(new, target, spec, 1)  # a replayed load replaces itself
    assert read_loads(spark, target, spec).count() == 4
    current = read_current(spark, target, spec)
    assert {(r.ticker, r.time.isoformat()[:10], str(r.open)) for r in current.collect()} == {
        ("A", "2024-01-31", "9.00"), ("A", "2024-02-01", "2.00"), ("B", "2024-02-02", "3.00")
    }
    february = read_current(spark, target, spec, parts=["202402"])
    assert february.count() == 2
    assert re.search(r"PartitionFilters: \[[^\]]*part_key", plan_of(february))
    last = compact(spark, target, spec)
    assert last == compact(spark, target, spec)
    assert tuples(read_current(spark, target, spec)) == tuples(current)
    assert read_loads(spark, target, spec).count() == 3
    append_load(current, target, spec, last + 1)
    assert tuples(read_current(spark, target, spec)) == tuples(current) and read_loads(spark, target, spec).count() == 6
    expire(spark, target)
    assert tuples(read_current(spark, target, spec)) == tuples(current) and read_loads(spark, target, spec).count() == 6


def _shown(df):
    return {(r.ticker, r.time.isoformat()[:10], int(r.open), r.volume) for r in df.collect()}


def _three_loads(spark):
    """Load 0 holds A and B, load 1 corrects B, load 2 corrects A and adds C in another month."""
    day = "2024-01-31T00:00:00"
    return (
        _bars(spark, [("A", day, "1", 0), ("B", day, "1", 0)]),
        _bars(spark, [("B", day, "2", 1), ("A", day, "2", 1)]),
        _bars(spark, [("A", day, "3", 2), ("C", "2024-02-01T00:00:00", "3", 2)]),
    )


ALL_THREE = {("A", "2024-01-31", 3, 2), ("B", "2024-01-31", 2, 1), ("C", "2024-02-01", 3, 2)}


@pytest.mark.parametrize("expired", [False, True])
def test_a_late_load_is_merged_as_if_it_had_come_in_time(spark, path, expired):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    append_load(loads[0], target, spec, 0)
    append_load(loads[2], target, spec, 2)
    assert compact(spark, target, spec) == 2
    if expired:
        expire(spark, target)
    append_load(loads[1], target, spec, 1)
    assert _shown(read_current(spark, target, spec)) == ALL_THREE
    compact(spark, target, spec)
    assert _shown(read_current(spark, target, spec)) == ALL_THREE
    expire(spark, target)
    assert _shown(read_current(spark, target, spec)) == ALL_THREE and read_loads(spark, target, spec).count() == 3


@pytest.mark.parametrize("expired", [False, True])
def test_a_load_written_again_after_compaction_replaces_itself(spark, path, expired):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    for n, load in enumerate(loads):
        append_load(load, target, spec, n)
    compact(spark, target, spec)
    if expired:
        expire(spark, target)
    append_load(loads[2], target, spec, 2)  # the same again
    assert _shown(read_current(spark, target, spec)) == ALL_THREE
    again = _bars(spark, [("C", "2024-02-01T00:00:00", "9", 9)])
    append_load(again, target, spec, 2)  # and without A
    a = set() if expired else {("A", "2024-01-31", 2, 1)}
    want = {("B", "2024-01-31", 2, 1), ("C", "2024-02-01", 9, 9)} | a
    for step in (lambda: None, lambda: compact(spark, target, spec), lambda: expire(spark, target), lambda: compact(spark, target, spec)):
        step()
        assert _shown(read_current(spark, target, spec)) == want


def test_a_reader_holds_its_version_through_expire(spark, path):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    append_load(loads[0], target, spec, 0)
    with held(spark, target) as snapshot:
        before = _shown(read_current(spark, target, spec, snapshot=snapshot))
        append_load(loads[2], target, spec, 2)
        append_load(loads[1], target, spec, 0)
        compact(spark, target, spec)
        expire(spark, target)
        assert _shown(read_current(spark, target, spec, snapshot=snapshot)) == before
        assert _shown(read_current(spark, target, spec)) != before
    expire(spark, target)
    with pytest.raises(Exception):
        read_current(spark, target, spec, snapshot=snapshot).collect()


def test_compaction_rewrites_only_the_partitions_that_loads_touch(spark, path):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    for n in (0, 2):
        append_load(loads[n], target, spec, n)
    compact(spark, target, spec)
    before = CommitLog(spark, target).latest().parts
    append_load(_bars(spark, [("D", "2024-02-09T00:00:00", "4", 4)]), target, spec, 5)
    compact(spark, target, spec)
    after = CommitLog(spark, target).latest().parts
    assert before["202401"] == after["202401"] and before["202402"] != after["202402"]
    assert read_current(spark, target, spec).count() == 4


def test_a_base_alone_is_read_without_a_shuffle_and_few_later_rows_leave_it_in_place(spark, path):
    spec, target = TABLES["fact_daily_price"], path("fact")
    rows = [(f"T{i}", f"2024-01-{1 + i % 28:02d}T00:00:00", "1", i) for i in range(20_000)]
    append_load(_bars(spark, rows), target, spec, 0)
    compact(spark, target, spec)
    assert "Exchange" not in plan_of(read_current(spark, target, spec))
    append_load(_bars(spark, [("T7", "2024-01-08T00:00:00", "2", -1), ("NEW", "2024-01-08T00:00:00", "2", -2)]), target, spec, 1)
    current = read_current(spark, target, spec)
    assert "LeftAnti" in plan_of(current) and "SortMergeJoin" not in plan_of(current)
    changed = {(r.ticker, r.volume) for r in current.where("volume < 0").collect()}
    assert changed == {("T7", -1), ("NEW", -2)} and current.count() == 20_001


def test_racing_writers_both_commit(spark, path):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    append_load(loads[0], target, spec, 0)
    log, tries = CommitLog(spark, target), []

    def change(now):
        if not tries:
            append_load(loads[2], target, spec, 2)  # another writer gets in between
        tries.append(now.version)
        return replace(now, loads={**now.loads, 1: now.loads[0]})

    assert sorted(log.commit(change).loads) == [0, 1, 2] and tries == [0, 1]


def test_uncommitted_attempts_are_never_read(spark, path):
    spec, target, loads = TABLES["fact_daily_price"], path("fact"), _three_loads(spark)
    append_load(loads[0], target, spec, 0)
    folder = CommitLog(spark, target).latest().loads[0]
    shutil.copytree(f"{target}/{folder}", f"{target}/batch_id=0/attempt=crashed")
    assert read_loads(spark, target, spec).count() == 2


def test_ranges_of_loads():
    assert ranges([3, 1, 2, 7], ((5, 5),)) == ((1, 3), (5, 5), (7, 7))
    assert without(((1, 3), (5, 5)), [2, 5, 9]) == ((1, 1), (3, 3))


def test_version_column_beats_load_order(spark, path):
    spec, target = TABLES["technical_indicators_daily"], path("indicators")
    row = lambda day, sma: ("A", dt.datetime(2024, 1, 2), dt.date(2024, 1, 2), Decimal("1"), 50.0, sma, dt.datetime(2024, 1, day))
    schema = ", ".join(f"{n} {t}" for n, t in spec.columns)
    append_load(spark.createDataFrame([row(5, 1.0)], schema), target, spec, 0)
    append_load(spark.createDataFrame([row(3, 2.0)], schema), target, spec, 1)
    assert [r.sma_10 for r in read_current(spark, target, spec).collect()] == [1.0]


def test_derived_tables_are_published_and_recalculated(spark, path):
    rows = [("A", f"2024-01-{d:02d}T00:00:00", str(d), 1) for d in range(1, 13)]
    daily, root = _bars(spark, rows), path("warehouse")
    assert publish_calendar(daily, root, 0) == 12
    assert read_current(spark, f"{root}/dim_date", TABLES["dim_date"]).count() == 12
    assert publish_indicators(daily, root, 0, long_term=True) == 12
    for batch_id, frame in ((0, daily), (1, daily.withColumn("close", F.col("close") * 2))):
        assert publish_indicators(frame, root, batch_id) == 12
    spec = TABLES["technical_indicators_daily"]
    last = read_current(spark, f"{root}/technical_indicators_daily", spec).orderBy("time").collect()[-1]
    assert (last.close, last.sma_10, last.rsi_3) == (Decimal("24.00"), 15.0, 100.0)


def test_layout_is_partitioned_by_time_and_sorted_by_key(spark, path):
    spec, target = TABLES["fact_daily_price"], path("sorted")
    rows = [(t, f"2024-01-{d:02d}T00:00:00", "1", d) for d in range(28, 0, -1) for t in "CAB"]
    append_load(_bars(spark, rows).repartition(4), target, spec, 0)
    folder = CommitLog(spark, target).latest().loads[0]
    stored = spark.read.parquet(f"{target}/{folder}/{PARTITION}=202401").coalesce(1).collect()
    keys = [(r.ticker, r.time) for r in stored]
    assert keys == sorted(keys)


def _scan_rows(df):
    """Rows that the file scans of a finished plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())


def test_a_read_of_one_ticker_opens_few_row_groups_of_a_base(spark, path):
    spec, target = TABLES["fact_daily_price"], path("fact")
    rows = [(f"T{i % 500:03d}", f"2024-01-{1 + i // 500 % 28:02d}T00:00:00", "1", i) for i in range(14_000)]
    append_load(_bars(spark, rows), target, spec, 0)
    compact(spark, target, spec)
    one = read_current(spark, target, spec).where("ticker = 'T123'")
    assert one.count() == 28
    # 14,000 rows in at least eight files of one row group: a ticker lies in one or two of them.
    assert _scan_rows(one) <= 14_000 / 3


def test_appends_read_the_tail_and_equal_a_full_calculation(spark, path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rng = random.Random(2)
    rows = [(t, f"{d}T00:00:00", str(rng.randint(1, 99)), 1) for t in "AB" for d in days] + [("NEW", f"{days[-1]}T00:00:00", "5", 1)]
    daily, root, table = _bars(spark, rows), path("warehouse"), "technical_indicators_daily"
    at = lambda i: F.lit(str(days[i])).cast("timestamp")
    publish_indicators(daily.where(F.col("time") < at(30)), root, 0)
    for load, (a, b) in enumerate([(30, 31), (31, 32), (32, 36), (36, 38)], 1):
        append_indicators(daily.where((F.col("time") >= at(a)) & (F.col("time") < at(b))), root, load)
    last = daily.where(F.col("time") >= at(38))
    for _ in range(2):  # an append written again decides as before
        append_indicators(last, root, 5)
    shown = lambda df: sorted((r.ticker, r.time, r.close, round(r.rsi_3 or -1, 9), round(r.sma_10 or -1, 9)) for r in df.collect())
    assert shown(read_current(spark, f"{root}/{table}", TABLES[table])) == shown(short_term_indicators(daily))
    # Nothing but the tail and the new days is scanned.
    tail = read_current(spark, f"{root}/tails/{table}/indicator_tail", TABLES["indicator_tail"])
    last.write.parquet(path("days"))
    plan = plan_of(appended_indicators(tail, spark.read.parquet(path("days"))))
    assert set(re.findall(r"Location: \S+ \[file:([^,\]]+)", plan)) and all("/tails/" in f or f.endswith("/days") for f in re.findall(r"Location: \S+ \[file:([^,\]]+)", plan))
    # A corrected day needs the history, for its ticker only.
    fixed = daily.withColumn("close", F.when((F.col("ticker") == "A") & (F.col("time") == at(20)), F.lit(50)).otherwise(F.col("close")).cast("decimal(20,2)"))
    correction = fixed.where((F.col("ticker") == "A") & (F.col("time") == at(20)))
    with pytest.raises(ValueError):
        append_indicators(correction, root, 6)
    append_indicators(correction, root, 6, history=fixed)
    assert shown(read_current(spark, f"{root}/{table}", TABLES[table])) == shown(short_term_indicators(fixed))


def test_history_goes_on_from_its_open_rows(spark, path):
    snapshot = lambda t, day, capital: (t, dt.datetime(2024, 1, day), Decimal(capital))
    schema, root, spec = "ticker string, as_of_date timestamp, charter_capital decimal(30,2)", path("warehouse"), TABLES["dim_company_history"]
    loads = [
        [snapshot("A", 1, 10), snapshot("B", 1, 10)],
        [snapshot("A", 3, 11), snapshot("A", 5, 12), snapshot("C", 5, 1)],
        [snapshot("A", 5, 13), snapshot("B", 9, 11)],  # the open day again
        [snapshot("A", 4, 99), snapshot("C", 7, 2)],  # a day that was missed
    ]
    publish_company_history(spark.createDataFrame(loads[0], schema), root, 0)
    for n, rows in enumerate(loads[1:], 1):
        for _ in range(2):
            append_company_history(spark.createDataFrame(rows, schema), root, n)
    got = read_current(spark, f"{root}/dim_company_history", spec).select("ticker", "valid_from", "charter_capital", "version", "valid_to", "is_current")
    newest = {(t, d): c for rows in loads for t, d, c in rows}
    every = spark.createDataFrame([(t, d, c) for (t, d), c in newest.items()], schema)
    want = company_history(every).select("ticker", F.col("as_of_date"), "charter_capital", "version", "valid_to", "is_current")
    assert tuples(got) == tuples(want)
