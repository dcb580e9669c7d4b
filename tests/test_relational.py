"""Joins, increments, bars, calendar, message encoding, connector options."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from tickloom.operators.bars import daily_bars, intraday_bars
from tickloom.operators.incremental import advance_marks, backfill_range, high_water, lookback, newer_than
from tickloom.operators.joins import members_only, with_calendar, with_dimension
from tickloom.plans.landing import new_tick_messages
from tickloom.plans.warehouse import calendar, company_history, stamp_calculation
from tickloom.session import SESSION_CONF, apply_session_conf
from tickloom.sinks.buckets import read_bucketed, write_bucketed
from tickloom.sinks.jdbc import STAGING, WAREHOUSE, write_options
from tickloom.sinks.messages import encode
from tickloom.sources.jdbc import read_options
from tickloom.sources.streams import broker_options, decode
from tickloom.specs import ARCHIVED_TOPICS, TABLES
from tickloom import workspace
from tickloom.workspace import shared_dir, sweep

T0 = dt.datetime(2024, 1, 2, 9, 0)
TICKS = "ticker string, time timestamp, price decimal(20,2), volume bigint, id int"


def ticks(spark, *rows):
    return spark.createDataFrame([(t, T0 + dt.timedelta(seconds=s), Decimal(p), v, i) for i, (t, s, p, v) in enumerate(rows)], TICKS)


def test_bars_open_and_close_follow_time_then_tie_break(spark):
    df = ticks(spark, ("A", 0, "5", 1), ("A", 10, "9", 2), ("A", 299, "1", 3), ("A", 299, "2", 4), ("A", 300, "7", 5), ("B", 0, "3", 6))
    out = {(r.ticker, r.time): tuple(r)[2:] for r in intraday_bars(df, tie_break=("id",)).collect()}
    d = Decimal
    assert out == {
        ("A", T0): (d("5.00"), d("9.00"), d("1.00"), d("2.00"), 10),
        ("A", T0 + dt.timedelta(minutes=5)): (d("7.00"),) * 4 + (5,),
        ("B", T0): (d("3.00"),) * 4 + (6,),
    }
    day = {r.ticker: tuple(r)[1:] for r in daily_bars(df, tie_break=("id",)).collect()}
    assert day["A"] == (T0.date(), d("5.00"), d("9.00"), d("1.00"), d("7.00"), 15)


def test_bars_of_a_keyed_table_use_a_hash_aggregate(spark):
    assert "SortAggregate" not in plan_of(daily_bars(ticks(spark, ("A", 0, "5", 1))))


def test_lookback_and_backfill_bounds(spark):
    days = [dt.datetime(2024, 1, d, h) for d in (1, 2, 3, 4, 5) for h in (0, 23)]
    df = spark.createDataFrame([(d,) for d in days], "time timestamp_ntz")
    assert sorted({r.time.day for r in lookback(df, "time", "2024-01-04").collect()}) == [2, 3, 4]
    assert lookback(df, "time", dt.date(2024, 1, 4)).count() == 6
    old = spark.createDataFrame([(dt.date(2014, 12, 31),), (dt.date(2015, 1, 1),), (dt.date(2024, 1, 1),)], "time date")
    assert backfill_range(old, "time", "2023-12-31").count() == 1
    with pytest.raises(TypeError):
        lookback(spark.createDataFrame([("2024-01-01",)], "time string"), "time", "2024-01-01")


def test_date_range_reaches_the_scan(spark, path):
    spark.range(10).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("time"), "id").write.parquet(path("t"))
    plan = plan_of(lookback(spark.read.parquet(path("t")), "time", "1970-01-01").select("id"))
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan


def test_high_water_is_strict_and_new_tickers_pass(spark):
    seen = ticks(spark, ("A", 0, "1", 1), ("A", 10, "1", 1))
    polled = ticks(spark, ("A", 0, "1", 1), ("A", 10, "1", 1), ("A", 11, "1", 1), ("B", 0, "1", 1))
    marks = high_water(seen)
    out = newer_than(polled, marks)
    assert out.columns == polled.columns
    assert sorted((r.ticker, (r.time - T0).seconds) for r in out.collect()) == [("A", 11), ("B", 0)]
    after = {r.ticker: (r.last_time - T0).seconds for r in advance_marks(marks, out).collect()}
    assert after == {"A": 11, "B": 0}
    messages, marks2 = new_tick_messages(polled, marks)
    assert messages.columns == ["key", "value"] and messages.count() == 2
    assert newer_than(polled, marks2).count() == 0


def test_joins(spark):
    facts = spark.createDataFrame([("A", dt.date(2024, 1, 6), 1), ("B", dt.date(2024, 1, 8), 2)], "ticker string, date_id date, v int")
    groups = spark.createDataFrame([("A", "G")], "ticker string, group string")
    assert [r.v for r in members_only(facts, groups).collect()] == [1]
    days = calendar(facts)
    assert days.count() == 3
    out = {r.ticker: r for r in with_dimension(with_calendar(facts, days), groups).collect()}
    assert (out["A"].group, out["A"].is_weekend, out["B"].group, out["B"].day_of_week) == ("G", 1, None, 1)


def test_hot_ticker_is_split_in_every_key_join(spark, path):
    spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("ticker"),
        F.timestamp_seconds("id").alias("time"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    ).repartition(8).write.parquet(path("ticks"))
    ticks = spark.read.parquet(path("ticks"))
    marks = high_water(ticks.where("time < timestamp_seconds(100000)"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # 66,666 rows are HOT; of the others, those below 100,000 have a mark.
        for joined, rows in ((newer_than(ticks, marks), 100_000), (members_only(ticks, marks), 133_333), (with_dimension(ticks, marks), 200_000)):
            assert abs(len(joined.collect()) - rows) <= 1
            assert "skew=true" in plan_of(joined, "simple")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_calendar_matches_its_table(spark):
    days = calendar(spark.createDataFrame([(dt.date(2024, 2, 28),), (dt.date(2024, 3, 1),)], "date_id date"))
    assert [(f.name, f.dataType.simpleString()) for f in days.schema] == list(TABLES["dim_date"].columns)
    assert [str(r.date_id) for r in days.orderBy("date_id").collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_company_history_and_calculation_stamp(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1)), ("A", dt.datetime(2024, 3, 1))], "ticker string, as_of_date timestamp")
    out = sorted(company_history(df).collect())
    assert [(r.version, r.valid_to, r.is_current) for r in out] == [(1, dt.datetime(2024, 3, 1), False), (2, None, True)]
    assert stamp_calculation(df).columns[-1] == "calculated_at"


def test_encode_and_decode(spark):
    row = encode(ticks(spark, ("A", 0, "1.5", 7))).collect()[0]
    assert (row.key, row.value) == ("A", '{"ticker":"A","time":"2024-01-02 09:00:00","price":"1.50","volume":7,"id":0}')
    df = spark.createDataFrame([(bytearray("Ä".encode()), "t", 1)], "value binary, topic string, offset bigint")
    assert [tuple(r) for r in decode(df).collect()] == [("Ä", "t")]


def test_connector_options():
    assert broker_options("h:1", ARCHIVED_TOPICS, "earliest") == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "benchmark_index,company_metadata,daily_price,daily_price_backfill,intraday_price,ticker_list",
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
            "maxOffsetsPerTrigger": "5000000",
    }
    assert read_options("jdbc:x", "t", {"user": "u"}) == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000", "user": "u"}
    split = read_options("jdbc:x", "t", {}, split_column="id", bounds=(0, 100), splits=8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "8")
    with pytest.raises(ValueError):
        read_options("jdbc:x", "t", {}, split_column="id")
    options = write_options("jdbc:x", "t", WAREHOUSE, "u", "p", 16)
    assert (options["batchsize"], options["isolationLevel"], options["numPartitions"]) == ("100000", "NONE", "16")
    assert write_options("jdbc:x", "t", STAGING, "u", "p", 4)["batchsize"] == "10000"


def test_session_settings(spark):
    apply_session_conf(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert not any(k in SESSION_CONF for k in ("spark.master", "spark.executor.memory", "spark.driver.memory"))
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base) and shared_dir(spark, "x") != shared_dir(spark, "x")


def test_bucketed_joins_shuffle_no_facts(spark, path):
    facts = spark.range(2000).select(F.concat(F.lit("T"), (F.col("id") % 37).cast("string")).alias("ticker"), F.timestamp_seconds("id").alias("time"), "id")
    dim = spark.range(30).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"), F.col("id").alias("size"))
    marks = dim.select("ticker", F.timestamp_seconds(F.col("size") * 50).alias("last_time"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = {name: write_bucketed(df, path(name), buckets=4) for name, df in (("facts", facts), ("dim", dim), ("marks", marks))}
        again = read_bucketed(spark, path("facts"), "ticker string, time timestamp, id bigint", buckets=4)
        for f in (wide["facts"], again):
            for joined, plain in (
                (with_dimension(f, wide["dim"], bucketed=True), with_dimension(facts, dim)),
                (members_only(f, wide["dim"], bucketed=True), members_only(facts, dim)),
                (newer_than(f, wide["marks"], bucketed=True), newer_than(facts, marks)),
            ):
                assert "Exchange" not in plan_of(joined) and "Exchange" in plan_of(plain)
                assert sorted(map(tuple, joined.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_scratch_of_applications_that_were_killed_is_swept(spark, path, monkeypatch):
    base = path("shared")
    monkeypatch.setattr(workspace, "shared_base", lambda _: base)
    own = shared_dir(spark, "x")
    spark.range(3).write.parquet(own)
    dead = f"{base}/scratch-{'0' * 32}"
    spark.range(3).write.parquet(f"{dead}/table-{'1' * 32}")
    spark.range(3).write.parquet(f"{base}/tables")
    os.utime(dead, (0, 0))
    assert sweep(spark, 3600) == 1 and sorted(os.listdir(base)) == sorted([own.split("/")[-2], "tables"])
