"""Tick, archive and incremental streams."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from tickloom.sinks.tables import read_current, read_loads
from tickloom.plans.batch import run_topic
from tickloom.sources.lake import read_json, scan_archive, scan_topic, split_corrupt
from tickloom.sources.streams import file_stream
from tickloom.specs import DATASETS, TABLES
from tickloom.streaming.archive import archived_hours, compact_archive, stamped_message, start_archive_stream
from tickloom.streaming.highwater import accept_batch, accepted_rows, start_incremental_stream
from tickloom.operators.bars import intraday_bars
from tickloom.streaming.recent import start_deduplicated_stream, start_new_tick_stream
from tickloom.streaming.ticks import latest_ticks, parse_ticks, start_bar_stream, start_tick_stream, wait, without_repeats, write_batch

SPEC = TABLES["fact_intraday_tick"]


def message(**fields):
    base = {"ticker": "VNM", "time": "2024-01-02 09:00:00", "price": 1.005, "volume": "100.0", "match_type": "LO",
            "buy_vol": 1, "sell_vol": "2", "ingested_at": "2024-01-02T09:00:01"}
    return json.dumps({k: v for k, v in {**base, **fields}.items() if v is not ...})


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_edge_messages(spark):
    df = frame(
        spark,
        message(),
        message(price="abc", volume="abc", sell_vol=None, match_type=None, time="2024-01-02 09:00:01"),
        message(time="bad"), message(ticker=...), message(time=None), "{broken", "[1,2]", '[{"ticker":"X"}]', "", "7",
        message(ingested_at="nonsense", time="2024-01-02 09:00:02"),
    )
    out = sorted(parse_ticks(df).collect(), key=lambda r: r.time)
    assert [r.time.second for r in out] == [0, 1, 2]
    assert tuple(out[0])[2:7] == (Decimal("1.01"), 100, "LO", 1, 2)
    assert tuple(out[1])[2:7] == (None, 0, " ", 1, 0)
    assert out[2].ingested_at is None
    assert [(f.name, f.dataType.simpleString()) for f in parse_ticks(df).schema] == list(SPEC.columns)


def test_binary_messages_are_decoded_and_parsed_once(spark):
    df = frame(spark, message()).select(F.col("value").cast("binary"))
    assert parse_ticks(df).count() == 1
    assert plan_of(parse_ticks(df), "simple").count("from_json(") == 1


def numbered_messages(n=60, seed=3):
    rng = random.Random(seed)
    return [
        message(ticker=f"T{i % 4}", time=f"2024-01-0{1 + i % 3} 09:00:0{i % 5}", price=str(i),
                ingested_at=f"2024-01-05T00:{rng.randint(0, 59):02d}:00")
        for i in range(n)
    ]


@pytest.mark.parametrize("files,per_batch", [(1, None), (3, 1), (7, 2)])
def test_stream_equals_batch_however_it_is_cut(spark, path, files, per_batch):
    messages = numbered_messages()
    os.makedirs(path("in"))
    for i in range(files):
        with open(f"{path('in')}/{i}.txt", "w") as f:
            f.write("\n".join(messages[i::files]))
    stream = file_stream(spark, path("in"), per_batch)
    wait(start_tick_stream(stream, path("table"), path("ckpt"), available_now=True))
    expected = sorted(tuple(r) for r in latest_ticks(parse_ticks(frame(spark, *messages))).collect())
    assert sorted(tuple(r) for r in read_current(spark, path("table"), SPEC).collect()) == expected
    # A restart finds nothing new and changes nothing.
    wait(start_tick_stream(file_stream(spark, path("in"), per_batch), path("table"), path("ckpt"), available_now=True))
    assert sorted(tuple(r) for r in read_current(spark, path("table"), SPEC).collect()) == expected


def test_replayed_batch_replaces_itself(spark, path):
    batch = parse_ticks(frame(spark, *numbered_messages(20)))
    write_batch(batch, 4, path("table"))
    before = read_loads(spark, path("table"), SPEC).count()
    write_batch(batch, 4, path("table"))
    assert read_loads(spark, path("table"), SPEC).count() == before
    assert [r.batch_id for r in read_loads(spark, path("table"), SPEC).select("batch_id").distinct().collect()] == [4]


def test_empty_batch_writes_nothing_and_missing_ingest_time_gets_now(spark, path):
    write_batch(parse_ticks(frame(spark, "{}")), 0, path("table"))
    assert not os.path.exists(path("table"))
    write_batch(parse_ticks(frame(spark, message(ingested_at=None))), 1, path("table"))
    assert read_current(spark, path("table"), SPEC).collect()[0].ingested_at > dt.datetime(2024, 1, 1)


def test_repeats_are_dropped_within_the_watermark(spark, path):
    os.makedirs(path("in"))
    for i in range(2):
        with open(f"{path('in')}/{i}.txt", "w") as f:
            f.write("\n".join([message(), message(), message(ticker="FPT")]))
    query = (
        without_repeats(parse_ticks(file_stream(spark, path("in"), 1)))
        .writeStream.format("parquet").option("path", path("out")).option("checkpointLocation", path("ckpt"))
        .trigger(availableNow=True).start()
    )
    wait(query)
    assert sorted(r.ticker for r in spark.read.parquet(path("out")).collect()) == ["FPT", "VNM"]


def test_stream_failures_are_raised(spark, path):
    os.makedirs(path("in"))
    with open(f"{path('in')}/0.txt", "w") as f:
        f.write(message())
    with open(path("file"), "w") as f:
        f.write("a file where the table should be")
    with pytest.raises(Exception):
        wait(start_tick_stream(file_stream(spark, path("in")), f"{path('file')}/table", path("ckpt"), available_now=True))


@pytest.mark.parametrize(
    "value,extra",
    [('{"a":1.0,"z":{"b":[1]},"é":"}"}', True), (' {"a": 1} ', True), ("{}", True), ('{"a":\n 1}', True),
     ("[1,2]", False), ("7", False), ("{broken", False), ("text", False), ("{a}", False)],
)
def test_only_objects_are_stamped(spark, value, extra):
    out = frame(spark, value).select(stamped_message(F.col("value"), F.current_timestamp())).collect()[0][0]
    if not extra:
        assert out == value
    else:
        stamped = json.loads(out)
        assert stamped.pop("kafka_ingested_at") and stamped == json.loads(value) and "\n" not in out


def test_restamping_keeps_the_last_stamp(spark, path):
    value = '{"ticker":"A","kafka_ingested_at":"old"}'
    df = frame(spark, value).select(stamped_message(F.col("value"), F.lit(dt.datetime(2024, 1, 2))).alias("value"))
    df.write.text(path("t"))
    row = read_json(spark, path("t"), "ticker string, kafka_ingested_at string").collect()[0]
    assert row.kafka_ingested_at.startswith("2024-01-02T00:00:00")


def test_archive_feeds_the_batch_scan(spark, path):
    for topic, lines in {
        "daily_price": ['{"ticker":"VNM","open":100.0}', "{broken"],
        "ticker_list": ['[{"ticker":"A","group":"G"},{"ticker":"B","group":"G"}]'],
    }.items():
        os.makedirs(f"{path('in')}/topic={topic}")
        with open(f"{path('in')}/topic={topic}/m.txt", "w") as f:
            f.write("\n".join(lines))
    for _ in range(2):  # the second run finds nothing new
        wait(start_archive_stream(file_stream(spark, path("in")), path("lake"), path("ckpt"), available_now=True))
    bars, corrupt = split_corrupt(scan_topic(spark, path("lake"), "daily_price", schema=DATASETS["daily_price"].raw_schema))
    assert [(r.ticker, r.open, r.kafka_ingested_at is not None) for r in bars.collect()] == [("VNM", "100.0", True)]
    assert corrupt.count() == 1
    tickers, _ = split_corrupt(scan_topic(spark, path("lake"), "ticker_list", schema=DATASETS["ticker_list"].raw_schema))
    assert sorted(r.ticker for r in tickers.collect()) == ["A", "B"]
    # A file the stream did not commit is invisible to the archive scan.
    hour = os.listdir(f"{path('lake')}/topic=daily_price")[0]
    with open(f"{path('lake')}/topic=daily_price/{hour}/part-left-behind.json", "w") as f:
        f.write('{"ticker":"LOST"}')
    archived, _ = split_corrupt(scan_archive(spark, path("lake"), "daily_price", schema=DATASETS["daily_price"].raw_schema))
    assert [r.ticker for r in archived.collect()] == ["VNM"]
    result = run_topic(spark, "daily_price", path("lake"), path("warehouse"), 0, hour=hour.split("=")[1], scan=scan_archive, quarantine_root=path("held"))
    assert (result.rows, result.quarantined) == (1, True)


def test_incremental_stream_drops_seen_and_late_ticks(spark, path):
    schema = "ticker string, time timestamp, id int"
    t = lambda s: dt.datetime(2024, 1, 2, 9, 0, s)
    polls = [
        [("A", t(1), 0), ("A", t(5), 1), ("B", t(1), 2)],
        [("A", t(1), 0), ("A", t(5), 1), ("A", t(5), 3), ("A", t(4), 4), ("A", t(6), 5)],
        [("A", t(6), 5), ("B", t(2), 6), ("C", t(1), 7)],
    ]
    for i, rows in enumerate(polls):
        spark.createDataFrame(rows, schema).write.parquet(f"{path('in')}/{i}")
        source = spark.readStream.schema(schema).parquet(f"{path('in')}/*")
        send = lambda messages: messages.write.mode("append").json(path("sent"))
        wait(start_incremental_stream(source, path("out"), path("ckpt"), send))
    out = accepted_rows(spark, path("out"), schema).collect()
    assert sorted((r.batch_id, r.id) for r in out) == [(0, 0), (0, 1), (0, 2), (1, 5), (2, 6), (2, 7)]
    sent = [(r.key, json.loads(r.value)["id"]) for r in spark.read.json(path("sent")).collect()]
    assert sorted(sent) == [("A", 0), ("A", 1), ("A", 5), ("B", 2), ("B", 6), ("C", 7)]


def test_replayed_poll_decides_as_before(spark, path):
    schema = "ticker string, time timestamp, id int"
    t = lambda s: dt.datetime(2024, 1, 2, 9, 0, s)
    first = spark.createDataFrame([("A", t(1), 0)], schema)
    second = spark.createDataFrame([("A", t(1), 0), ("A", t(2), 1)], schema)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        accept_batch(batch, batch_id, path("rows"), path("marks"))
    assert sorted((r.batch_id, r.id) for r in spark.read.parquet(path("rows")).collect()) == [(0, 0), (1, 1)]


def test_periodic_trigger(spark, path):
    os.makedirs(path("in"))
    with open(f"{path('in')}/0.txt", "w") as f:
        f.write(message())
    query = start_tick_stream(file_stream(spark, path("in")), path("table"), path("ckpt"), trigger="1 second")
    query.processAllAvailable()
    query.stop()
    assert read_current(spark, path("table"), SPEC).count() == 1
    assert query.lastProgress is None or query.lastProgress["batchId"] >= 0


STATE_SCHEMA = "ticker string, time timestamp, id int"


def second(s):
    return dt.datetime(2024, 1, 2, 9, 0) + dt.timedelta(seconds=s)


def growing_polls(n=6):
    """Each poll holds all ticks so far; some ticks share a time, one arrives in a later poll than its neighbours."""
    ticks = [(f"T{i % 3}", second(i // 2), i) for i in range(60)]
    late = ("T1", second(4), 999)
    return [ticks[: 10 * (i + 1)] + ([late] if i >= 2 else []) for i in range(n)], {*ticks, late}


@pytest.mark.parametrize("runs", [[1, 1, 1, 1, 1, 1], [6], [1, 4, 1], [3, 3]])
def test_any_grouping_of_polls_gives_the_same_ticks(spark, path, runs):
    polls, expected = growing_polls()
    at = 0
    for run in runs:  # every run is a restart from the checkpoint
        for poll in polls[at : at + run]:
            spark.createDataFrame(poll, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(path("in"))
        at += run
        wait(start_new_tick_stream(spark.readStream.schema(STATE_SCHEMA).parquet(path("in")), path("out"), path("ckpt")))
    out = [tuple(r) for r in spark.read.schema(STATE_SCHEMA).parquet(path("out")).collect()]
    assert sorted(out) == sorted(expected)


def test_rows_without_ticker_or_time_never_pass_and_forgotten_rows_are_late(spark, path):
    first = [("A", second(0), 1), ("A", second(3600), 2), (None, second(0), 3), ("A", None, 4), ("B", second(0), 5)]
    again = [("A", second(0), 1), ("A", second(3600), 2), ("A", second(3599), 6), ("A", second(3600), 7), ("B", second(1), 8)]
    for rows in (first, again):
        spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("append").parquet(path("in"))
        source = spark.readStream.schema(STATE_SCHEMA).parquet(path("in"))
        wait(start_deduplicated_stream(source, path("out"), path("ckpt"), delay_seconds=600))
    out = spark.read.schema(f"{STATE_SCHEMA}, is_late boolean").parquet(path("out"))
    assert sorted((r.ticker, r.id, r.is_late) for r in out.collect()) == [
        ("A", 1, False), ("A", 1, True), ("A", 2, False), ("A", 6, False), ("B", 5, False), ("B", 8, False)
    ]


def test_a_silent_ticker_is_forgotten(spark, path):
    for rows in ([("A", second(0), 1)], [("B", second(1), 2)], [("A", second(0), 1)]):
        spark.createDataFrame(rows, STATE_SCHEMA).write.mode("append").parquet(path("in"))
        from tickloom.streaming.recent import first_seen

        source = spark.readStream.schema(STATE_SCHEMA).parquet(path("in"))
        writer = first_seen(source, silent_seconds=0).writeStream.format("parquet").option("path", path("out"))
        wait(writer.option("checkpointLocation", path("ckpt")).trigger(availableNow=True).start())
    assert sorted(r.id for r in spark.read.schema(STATE_SCHEMA).parquet(path("out")).collect()) == [1, 1, 2]


def test_a_backlog_without_poll_numbers_is_sent_once(spark, path):
    polls, _ = growing_polls()
    batch = spark.createDataFrame([t for poll in polls for t in poll], STATE_SCHEMA)
    accept_batch(batch, 0, path("rows"), path("marks"))
    assert spark.read.parquet(path("rows")).count() == 61


def test_stream_bars_equal_batch_bars_and_close_once(spark, path):
    schema = "ticker string, time timestamp, price decimal(20,2), volume bigint, id int"
    rng = random.Random(5)
    trades = [(f"T{i % 3}", second(30 * i + rng.randint(0, 20)), Decimal(rng.randint(1, 99)), i, i) for i in range(200)]
    end = ("END", second(86_400), Decimal(0), 0, -1)
    too_late = ("T0", second(0), Decimal(1), 1, -2)
    for rows in (trades[:90], trades[90:], [end], [too_late]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path("in"))
        source = spark.readStream.schema(schema).parquet(path("in"))
        wait(start_bar_stream(source, path("out"), path("ckpt"), tie_break=("id",)))
    out = [tuple(r) for r in spark.read.parquet(path("out")).select("ticker", "time", "open", "high", "low", "close", "volume").collect()]
    want = intraday_bars(spark.createDataFrame(trades, schema), tie_break=("id",)).select("ticker", "time", "open", "high", "low", "close", "volume")
    assert sorted(out) == sorted(tuple(r) for r in want.collect())


def test_merged_hours_are_read_once_and_open_ones_refused(spark, path):
    os.makedirs(f"{path('in')}/topic=daily_price")
    for i in range(6):
        with open(f"{path('in')}/topic=daily_price/{i}.txt", "w") as f:
            f.write(json.dumps({"ticker": f"T{i}", "open": i}) + "\n{broken")
        wait(start_archive_stream(file_stream(spark, path("in")), path("lake"), path("ckpt"), available_now=True))
    schema = DATASETS["daily_price"].raw_schema
    before = sorted((r.ticker or "", r._corrupt_record or "") for r in scan_archive(spark, path("lake"), "daily_price", schema=schema).collect())
    for hour in archived_hours(spark, path("lake"), "daily_price"):
        with pytest.raises(ValueError):
            compact_archive(spark, path("lake"), "daily_price", hour)
        assert compact_archive(spark, path("lake"), "daily_price", hour, settle_seconds=-7200)
        assert not compact_archive(spark, path("lake"), "daily_price", hour, settle_seconds=-7200)
    after = scan_archive(spark, path("lake"), "daily_price", schema=schema)
    assert sorted((r.ticker or "", r._corrupt_record or "") for r in after.collect()) == before and len(before) == 12
    hour = archived_hours(spark, path("lake"), "daily_price")[0]
    assert 0 < scan_archive(spark, path("lake"), "daily_price", hour, schema).count() <= 12
    assert all(".compacted/" in r[0] for r in after.select(F.input_file_name()).distinct().collect())
