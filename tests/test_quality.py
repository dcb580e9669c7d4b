"""Quality rules, reports and the gate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators.quality import batch_sizes, failing_by_counts, kind_of, quality_counts, quality_report, rolled_up, split_by_quality
from tickloom.sources.lake import read_any_case
from tickloom.specs import QUALITY

SCHEMA = "time string, open double, high double, low double, close double, volume bigint, ticker string"
GOOD = ("2024-01-02", 1.0, 2.0, 0.5, 1.5, 10, "OK")


def report(df, topic="daily_price"):
    return sorted((r.ticker, r["check"], r.column, r["count"]) for r in quality_report(df, topic).collect())


def changed(**values):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple({**dict(zip(names, GOOD)), **values}[n] for n in names)


def test_six_topics_have_rules():
    assert set(QUALITY) == {
        "daily_price", "intraday_price", "benchmark_index", "ticker_list", "company_metadata", "financial_ratio"
    }


def test_clean_batch_has_an_empty_report(spark):
    assert report(spark.createDataFrame([GOOD, GOOD], SCHEMA)) == []


def test_nulls_nan_and_bounds_are_counted_per_ticker(spark):
    rows = [
        GOOD,
        changed(ticker="N", close=None),
        changed(ticker="N", close=float("nan"), open=float("nan")),
        changed(ticker="N", low=-1.0),
        changed(ticker="Z", low=0.0, volume=0),
        changed(ticker="V", volume=-5, time=None),
    ]
    assert report(spark.createDataFrame(rows, SCHEMA)) == [
        ("N", "below_min", "low", 1),
        ("N", "null_violation", "close", 2),
        ("N", "null_violation", "open", 1),
        ("V", "below_min", "volume", 1),
        ("V", "null_violation", "time", 1),
    ]


def test_missing_and_mistyped_columns_concern_every_ticker(spark):
    df = spark.createDataFrame([GOOD, changed(ticker="B")], SCHEMA).withColumn("open", F.lit(1)).drop("volume")
    assert report(df) == [
        ("B", "missing_column", "volume", 1), ("B", "type_error", "open", 1),
        ("OK", "missing_column", "volume", 1), ("OK", "type_error", "open", 1),
    ]
    good, held = split_by_quality(df, "daily_price")
    assert good.count() == 0 and held.count() == 2


def test_frame_without_ticker_column(spark):
    df = spark.createDataFrame([GOOD], SCHEMA).drop("ticker")
    assert report(df) == [(None, "missing_column", "ticker", 1)]


def test_volume_may_be_float_or_whole_or_null_where_allowed(spark):
    floats = spark.createDataFrame([changed(volume=None)], SCHEMA).withColumn("volume", F.col("volume").cast("double"))
    assert report(floats, "intraday_price") == [] and report(floats, "benchmark_index") == []
    assert report(floats) == [("OK", "null_violation", "volume", 1)]
    negative = spark.createDataFrame([changed(volume=-1)], SCHEMA)
    assert report(negative, "benchmark_index") == []
    assert report(negative, "intraday_price") == [("OK", "below_min", "volume", 1)]


def test_text_is_coerced_for_bounds(spark):
    df = spark.createDataFrame([changed()], SCHEMA).withColumn("low", F.lit("-3"))
    assert ("OK", "below_min", "low", 1) in report(df) and ("OK", "type_error", "low", 1) in report(df)
    unreadable = spark.createDataFrame([changed()], SCHEMA).withColumn("low", F.lit("x"))
    assert report(unreadable) == [("OK", "type_error", "low", 1)]


def test_unbounded_ranges_and_optional_metrics(spark):
    df = spark.createDataFrame([("VNM", 2020, "Q1", -3.0)], "ticker string, year int, quarter string, pe double")
    assert report(df, "financial_ratio") == []
    whole = spark.createDataFrame([("VNM", 2020.0, "Q1", -3)], "ticker string, year double, quarter string, pe int")
    assert report(whole, "financial_ratio") == [("VNM", "type_error", "pe", 1)]


def test_upper_bounds_ignore_nan(spark, monkeypatch):
    from tickloom.specs import QualitySpec

    monkeypatch.setitem(QUALITY, "bounded", QualitySpec(ranges={"x": (0, 10)}))
    df = spark.createDataFrame([("A", 11.0), ("A", float("nan")), ("A", 10.0), ("A", -1.0)], "ticker string, x double")
    assert report(df, "bounded") == [("A", "above_max", "x", 1), ("A", "below_min", "x", 1)]


def test_unknown_topic_passes(spark):
    df = spark.createDataFrame([GOOD], SCHEMA)
    assert report(df, "nothing_known") == []
    good, held = split_by_quality(df, "nothing_known")
    assert good.count() == 1 and held.count() == 0


def test_gate_withholds_the_whole_ticker_and_null_tickers(spark):
    rows = [GOOD, changed(ticker="B"), changed(ticker="B", close=None), changed(ticker=None)]
    good, held = split_by_quality(spark.createDataFrame(rows, SCHEMA), "daily_price")
    assert [r.ticker for r in good.collect()] == ["OK"]
    assert sorted(str(r.ticker) for r in held.collect()) == ["B", "B", "None"]
    assert {(r.ticker, r.row_count, r.column_count) for r in batch_sizes(held).collect()} == {("B", 2, 7), (None, 1, 7)}


@pytest.mark.parametrize(
    "ddl,kind",
    [("int", "i"), ("bigint", "i"), ("float", "f"), ("double", "f"), ("string", "O"), ("boolean", "b"),
     ("timestamp", "M"), ("decimal(20,2)", "O"), ("array<int>", "O")],
)
def test_kinds(spark, ddl, kind):
    assert kind_of(spark.createDataFrame([], f"x {ddl}").schema[0].dataType) == kind


def test_kept_counts_add_up_and_decide_without_the_rows(spark):
    rows = [("A", "1", 1.0, 1.0, 1.0, 1.0, 1), ("A", None, 1.0, 1.0, 1.0, 1.0, 1), ("B", "1", -1.0, 1.0, 1.0, None, 1), ("C", "1", 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows * 5, "ticker string, time string, open double, high double, low double, close double, volume bigint").withColumn("type", F.lit("t"))
    half = F.pmod(F.monotonically_increasing_id(), F.lit(2))
    hours = [quality_counts(df.withColumn("_h", half).where(F.col("_h") == h).drop("_h"), "daily_price", F.lit(f"h{h}")) for h in (0, 1)]
    counts = hours[0].unionByName(hours[1])
    report = quality_report(df, "daily_price").collect()
    assert sorted(map(tuple, rolled_up(counts.where("check <> 'rows'")).select("topic", "ticker", "check", "column", "count").collect())) == sorted(map(tuple, report))
    assert sum(r["count"] for r in counts.where("check = 'rows'").collect()) == 20
    accepted, held = split_by_quality(df, "daily_price", failing_by_counts(counts))
    assert {r.ticker for r in accepted.collect()} == {"C"} and held.count() == 15


def test_an_absent_field_is_charged_to_the_tickers_that_lack_it(spark, path):
    import json
    import os

    bar = {"time": "2024-01-02", "open": "1", "high": "1", "low": "1", "close": "1"}
    os.makedirs(path("lake"))
    with open(f"{path('lake')}/x.json", "w") as f:
        f.write("\n".join(json.dumps({**bar, "ticker": t, **({"volume": "5"} if t == "A" else {})}) for t in "AAB"))
    raw = read_any_case(spark, path("lake"), "ticker string, time string, open double, high double, low double, close double, volume double".replace("double", "string"))
    found = {(r.ticker, r.column, r["count"]) for r in quality_report(raw, "daily_price").where("check = 'missing_column'").collect()}
    assert found == {("B", "volume", 1)}
