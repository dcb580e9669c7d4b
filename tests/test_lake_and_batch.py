"""Raw lake in, published tables out."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import os
import time
from decimal import Decimal

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from tickloom.plans.batch import normalize, normalize_loads, run, run_topic
from tickloom.plans.landing import land, prepare, relabel_index, ticker_rows
from tickloom.session import shuffles_dropped
from tickloom.sinks.lake import write_records
from tickloom.sinks.tables import append_load, read_current, read_loads
from tickloom.sources.lake import CORRUPT, hour_of_file, read_json, scan_partitioned, scan_topic, split_corrupt, topic_path
from tickloom.specs import DATASETS, TABLES
from tickloom.suite.queries import registered

BAR = {"ticker": " VNM ", "time": "2024-01-02", "open": 1.005, "high": 2, "low": 0.5, "close": 1.5, "volume": 100.0}


def put(root, topic, hour, name, content, hive=True):
    folder = topic_path(root, topic, hour, hive)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def test_paths():
    assert topic_path("s3a://lake/", "daily_price", "2024-01-02_03") == "s3a://lake/topic=daily_price/dt_hour=2024-01-02_03"
    assert topic_path("lake", "daily_price", "2024-01-02_03", hive_style=False) == "lake/daily_price/2024-01-02_03"
    assert topic_path("lake", "daily_price", "") == topic_path("lake", "daily_price") == "lake/topic=daily_price"


@pytest.mark.parametrize("hive", [True, False])
def test_both_file_shapes_and_a_malformed_one(spark, path, hive):
    root = path("lake")
    put(root, "daily_price", "2024-01-02_03", "VNM.json", [BAR, {**BAR, "ticker": "FPT"}], hive)
    put(root, "daily_price", "2024-01-02_04", "m.json", {**BAR, "ticker": "HPG", "kafka_ingested_at": "x"}, hive)
    put(root, "daily_price", "2024-01-02_04", "bad.json", '{"ticker": "BAD", ', hive)
    spec = DATASETS["daily_price"]
    readable, corrupt = split_corrupt(scan_topic(spark, root, "daily_price", None, spec.raw_schema, hive))
    assert sorted(r.ticker.strip() for r in readable.collect()) == ["FPT", "HPG", "VNM"]
    assert [r[CORRUPT] for r in corrupt.collect()] == ['{"ticker": "BAD", ']
    hour, _ = split_corrupt(scan_topic(spark, root, "daily_price", "2024-01-02_03", spec.raw_schema, hive))
    assert sorted(r.ticker.strip() for r in hour.collect()) == ["FPT", "VNM"]


def test_files_with_different_columns_and_inferred_schema(spark, path):
    root = path("lake")
    put(root, "t", None, "a.json", {"ticker": "A", "pe": 1.5})
    put(root, "t", None, "b.json", {"ticker": "B", "pb": 2})
    df = read_json(spark, topic_path(root, "t"))
    assert sorted((r.ticker, r.pe, r.pb) for r in df.collect()) == [("A", 1.5, None), ("B", None, 2)]
    good, bad = split_corrupt(df)
    assert good.count() == 2 and bad.count() == 0


def test_hour_filter_prunes_folders(spark, path):
    root = path("lake")
    for hour in ("2024-01-02_03", "2024-01-02_04"):
        put(root, "daily_price", hour, "a.json", BAR)
    df = scan_partitioned(spark, root, "daily_price", DATASETS["daily_price"].raw_schema, "2024-01-02_04")
    assert [r.dt_hour for r in df.collect()] == ["2024-01-02_04"]
    assert "PartitionFilters: [isnotnull(dt_hour" in plan_of(df)


def test_edge_rows_of_a_bar(spark):
    raw = spark.createDataFrame(
        [("  VNM ", "2024-01-02", 1.005, 1e30, None, 1.5, "100.0", "daily_price"),
         ("VNM", None, 1.0, 1.0, 1.0, 1.0, "abc", "daily_price"),
         ("VNM", None, 2.0, 1.0, 1.0, 1.0, None, "daily_price")],
        "ticker string, time string, open double, high double, low double, close double, volume string, type string",
    )
    out = sorted(normalize(raw, DATASETS["daily_price"]).collect(), key=lambda r: r.time)
    epoch = dt.datetime(1970, 1, 1)
    assert len(out) == 2 and "type" not in out[0].asDict()
    assert (out[0].time, out[0].date_id, out[0].open, out[0].volume) == (epoch, epoch.date(), Decimal("2.00"), 0)
    assert (out[1].ticker, out[1].open, out[1].high, out[1].low, out[1].volume, out[1].date_id) == (
        "VNM", Decimal("1.01"), Decimal("0.00"), Decimal("0.00"), 100, dt.date(2024, 1, 2))


def test_company_dates_and_latest_snapshot(spark):
    raw = spark.createDataFrame(
        [("VNM", "31/12/2015", "2015-12-31", "7.5", "12.0", "2024-01-01"), ("VNM", "junk", None, "8.555", None, "2024-02-01"),
         ("FPT", "2015-12-31 00:00:00", "junk", "x", "1", None)],
        "ticker string, founded_date string, listing_date string, charter_capital string, number_of_employees string, as_of_date string",
    )
    out = {r.ticker: r for r in normalize(raw, DATASETS["company_metadata"]).collect()}
    assert (out["VNM"].founded_date, out["VNM"].listing_date, out["VNM"].charter_capital) == (" ", " ", Decimal("8.56"))
    assert (out["FPT"].founded_date, out["FPT"].listing_date, out["FPT"].charter_capital) == ("2015-12-31", " ", Decimal("0.00"))
    assert out["FPT"].as_of_date == dt.datetime(1970, 1, 1)


def test_ratio_casts_only_what_is_there(spark):
    raw = spark.createDataFrame([("VNM", "2020.0", "Q1", "12.34567")], "ticker string, year string, quarter string, PE string")
    out = normalize(raw, DATASETS["financial_ratio"])
    assert "ps" not in out.columns
    assert tuple(out.collect()[0]) == ("VNM", 2020, "Q1", Decimal("12.3457"))


def test_ratio_job_keeps_any_spelling_and_leaves_absent_metrics_null(spark, path):
    put(path("lake"), "financial_ratio", "2024-01-02_03", "a.json", {"Ticker": "VNM", "YEAR": "2020", "quarter": "Q1", "PE": 12.5, "pb": None})
    put(path("lake"), "financial_ratio", "2024-01-02_04", "b.json", [{"ticker": "FPT", "year": 2021, "quarter": "Q2", " EV EBITDA": 3}])
    put(path("lake"), "financial_ratio", "2024-01-02_04", "c.json", "{oops")
    result = run_topic(spark, "financial_ratio", path("lake"), path("warehouse"), 0)
    assert (result.rows, result.corrupt_rows, result.quarantined) == (2, 1, False)
    out = {r.ticker: r for r in read_current(spark, f"{path('warehouse')}/fact_financial_ratio", TABLES["fact_financial_ratio"]).collect()}
    assert (out["VNM"].pe, out["VNM"].pb, out["VNM"].ps, out["VNM"].ev_ebitda) == (Decimal("12.5"), Decimal(0), None, Decimal(0))
    assert (out["FPT"].pe, out["FPT"].ev_ebitda, out["FPT"].roe) == (Decimal(0), Decimal(3), None)


def test_later_load_wins_on_equal_versions(spark, path):
    spec = TABLES["fact_intraday_tick"]
    for load, price in enumerate(("100", "90")):
        row = [("VNM", dt.datetime(2024, 1, 2), price, dt.datetime(2024, 1, 3))]
        append_load(spark.createDataFrame(row, "ticker string, time timestamp, price string, ingested_at timestamp"), path("ticks"), spec, load)
    assert [r.price for r in read_current(spark, path("ticks"), spec).collect()] == [Decimal(90)]


def test_backfill_is_superseded_by_daily(spark):
    schema = "ticker string, time string, open string, high string, low string, close string, volume string, type string"
    backfill = spark.createDataFrame([("A", "2024-01-01", "9", "9", "9", "9", "9", "b"), ("A", "2024-01-02", "9", "9", "9", "9", "9", "b")], schema)
    daily = spark.createDataFrame([(" A", "2024-01-02", "1", "1", "1", "1", "1", "d")], schema)
    out = sorted(normalize_loads([(backfill, DATASETS["daily_price_backfill"]), (daily, DATASETS["daily_price"])]).collect())
    assert [(r.time.day, r.open) for r in out] == [(1, Decimal("9.00")), (2, Decimal("1.00"))]


def test_job_runs_end_to_end_and_twice_the_same(spark, path):
    lake, warehouse, quarantine = path("lake"), path("warehouse"), path("quarantine")
    put(lake, "daily_price", "2024-01-02_03", "a.json", [BAR, BAR, {**BAR, "ticker": "FPT"}])
    put(lake, "daily_price", "2024-01-02_03", "bad.json", "{oops")
    for _ in range(2):
        result = run_topic(spark, "daily_price", lake, warehouse, 7, hour="2024-01-02_03", quarantine_root=quarantine)
        assert (result.rows, result.quarantined) == (2, True)
    table, spec = f"{warehouse}/fact_daily_price", TABLES["fact_daily_price"]
    assert read_loads(spark, table, spec).count() == 2
    row = read_current(spark, table, spec).where("ticker = 'VNM'").collect()[0]
    assert (row.open, row.volume, row.time) == (Decimal("1.01"), 100, dt.datetime(2024, 1, 2))
    assert spark.read.json(f"{quarantine}/daily_price").count() == 1


def test_every_dataset_runs(spark, path):
    lake, warehouse = path("lake"), path("warehouse")
    for topic, spec in DATASETS.items():
        put(lake, topic, "2024-01-02_03", "a.json", [{**BAR, "group": "G", "year": 2020, "quarter": "Q1", "type": topic}])
        assert run(spark, spec, lake, warehouse, 0).rows == 1
        assert read_current(spark, f"{warehouse}/{spec.table}", TABLES[spec.table]).collect()[0].ticker == "VNM"


def test_empty_folder_writes_nothing(spark, path):
    lake, warehouse = path("lake"), path("warehouse")
    os.makedirs(topic_path(lake, "daily_price", "2024-01-02_03"))
    assert run_topic(spark, "daily_price", lake, warehouse, 0, hour="2024-01-02_03").rows == 0
    assert not os.path.exists(f"{warehouse}/fact_daily_price")


def test_failures_are_raised(spark, path):
    with pytest.raises(Exception):
        run_topic(spark, "daily_price", path("no_such_lake"), path("warehouse"), 0)


def test_write_records_reports_whether_anything_was_written(spark, path):
    df = spark.createDataFrame([("Ä", None, dt.datetime(2024, 1, 2))], "ticker string, x int, time timestamp")
    assert write_records(df, path("lake"), "t", "2024-01-02_03") is True
    assert write_records(df.where("ticker = 'none'"), path("empty"), "t", "2024-01-02_03") is False
    assert write_records(df, path("lake"), "by_ticker", "2024-01-02_03", by_ticker=True) is True
    assert os.path.isdir(f"{path('lake')}/topic=by_ticker/dt_hour=2024-01-02_03")
    files = [f for f in os.listdir(topic_path(path("lake"), "t", "2024-01-02_03")) if f.endswith(".json")]
    with open(f"{topic_path(path('lake'), 't', '2024-01-02_03')}/{files[0]}", encoding="utf-8") as f:
        assert json.loads(f.read()) == {"ticker": "Ä", "x": None, "time": "2024-01-02T00:00:00.000Z"}


def test_packed_records_are_small_files_that_read_the_same(spark, path, monkeypatch):
    monkeypatch.setattr("tickloom.sinks.lake.PACKED_ROWS", 1000)
    feed = spark.range(5000).selectExpr("concat('  S', id % 7) ticker", "'2024-01-02' time", "if(id % 3 = 0, null, id) open", "'Ä' type").coalesce(1)
    rows, sizes = [], []
    for packed in (False, True):
        root = path(f"lake-{packed}")
        assert write_records(feed, root, "t", "2024-01-02_03", packed=packed) is True
        folder = topic_path(root, "t", "2024-01-02_03")
        files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")]
        sizes.append(sum(map(os.path.getsize, files)))
        schema = "ticker string, time string, open string, type string"
        rows.append(sorted(map(str, split_corrupt(scan_topic(spark, root, "t", schema=schema, with_hour=True))[0].collect())))
    lines = []
    for file in files:
        with gzip.open(file, "rt", encoding="utf-8") as f:
            lines.append(len(f.readlines()))
    assert rows[0] == rows[1] and len(rows[0]) == sum(lines) == 5000 and max(lines) <= 1000
    assert sizes[1] < sizes[0] / 4
    assert write_records(feed.where("ticker = 'none'"), path("empty"), "t", "2024-01-02_03", packed=True) is False


def _lineitem(spark, path):
    rows = [(k, k % 5, k % 3, k % 7 + 1, k % 9 + 0.5, 100.0 + k, dt.datetime(2024, 1, 1 + k % 28)) for k in range(200)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, names).write.parquet(path("tables") + "/lineitem.parquet")
    return path("tables")


@pytest.mark.parametrize("name", ["daily_price_backfill_job", "later_hour_wins"])
def test_lakes_of_the_jobs_are_packed(spark, path, monkeypatch, name):
    monkeypatch.setattr("tickloom.suite.queries.shared_dir", lambda spark, label: path(label))
    shown = registered()[name](spark, _lineitem(spark, path)).collect()
    assert len(shown) == len({(r.ticker, r.time) for r in shown}) >= 84  # three tickers on 28 days, or the epoch
    found = [f"{d}/{f}" for top in ("job", "hours") for d, _, files in os.walk(f"{path(top)}/lake") for f in files if f.startswith("part-") and "/topic=" in d]
    assert {f.rsplit(".", 1)[-1] for f in found} == ({"gz", "txt"} if name.endswith("job") else {"gz"})  # broken records are laid down as text


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}


def test_shuffle_files_of_lakes_and_tables_go_once_written(spark, path):
    bars = spark.createDataFrame([(f"S{i % 50}", str(dt.date(2024, 1, 1 + i % 28)), str(i)) for i in range(500)], "ticker string, time string, open string")
    was, key = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    write_records(bars, path("lake"), "daily_price", "2024-01-02_17")
    assert run_topic(spark, "daily_price", path("lake"), path("tables"), 0).rows == len({(r.ticker, r.time) for r in bars.collect()})
    until = time.time() + 20
    while _shuffle_files(spark) - was and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - was
    assert spark.conf.get(key, None) is None


def test_the_setting_that_drops_shuffles_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with shuffles_dropped(spark):
        with shuffles_dropped(spark.newSession()):
            pass
        with pytest.raises(ValueError), shuffles_dropped(spark):
            raise ValueError
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "false")
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == "false"
    spark.conf.unset(key)


def test_the_hour_is_the_name_of_the_folder(spark):
    files = ["file:/a/topic=t/dt_hour=2024-01-02_03/p.json", "s3a://a/t/2024-01-02_03/p.json.gz", "s3a://b/xdt_hour=1/p", "s3a://b/dt_hour=dt_hour=1/p", "file:/a//p", "/p"]
    named = spark.createDataFrame([(f,) for f in files], "path string").select(F.struct(F.col("path").alias("file_path")).alias("_metadata"))
    assert [r[0] for r in named.select(hour_of_file()).collect()] == ["2024-01-02_03", "2024-01-02_03", "xdt_hour=1", "dt_hour=1", "", ""]


def test_landing_gates_and_quarantines(spark, path):
    frame = spark.createDataFrame(
        [("2024-01-02", 1.0, 1.0, 1.0, 1.0, 5, "OK"), ("2024-01-02", 1.0, 1.0, -1.0, 1.0, 5, "BAD"), ("2024-01-03", 1.0, 1.0, 1.0, 1.0, 5, "BAD")],
        "Time string, open double, high double, low double, close double, volume bigint, ticker string",
    )
    assert land(frame, "daily_price", path("lake"), "2024-01-02_03", path("held")) is True
    landed, _ = split_corrupt(scan_topic(spark, path("lake"), "daily_price", schema=DATASETS["daily_price"].raw_schema))
    assert [(r.ticker, r.type) for r in landed.collect()] == [("OK", "daily_price")]
    held, _ = split_corrupt(scan_topic(spark, path("held"), "daily_price", schema=DATASETS["daily_price"].raw_schema))
    assert [r.ticker for r in held.collect()] == ["BAD", "BAD"]
    assert land(frame.where("ticker = 'BAD'"), "daily_price", path("lake2"), "2024-01-02_03") is False


def test_feed_helpers(spark):
    index = relabel_index(spark.createDataFrame([("VN30",), ("VNM",)], "ticker string"))
    assert [r.ticker for r in index.collect()] == ["VN30_INDEX", "VNM"]
    rows = ticker_rows(spark.createDataFrame([("VNM",)], "symbol string"), "VN30").collect()
    assert [tuple(r) for r in rows] == [("VNM", "VN30", "ticker_list")]
    assert prepare(spark.createDataFrame([(1,)], "` EV EBITDA` int"), "x").columns == ["ev_ebitda", "type"]
