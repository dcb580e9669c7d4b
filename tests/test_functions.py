"""Casts, whole-frame projections and dates, on the edge rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import columns as C
from tickloom.functions.casts import has_column, retype
from tickloom.functions.temporal import (
    calendar_parts,
    day_key,
    flexible_date,
    hour_bucket,
    message_stamp,
    month_key,
)

D = Decimal


def one(df):
    return df.collect()[0]


def test_trim_strips_blanks_only_and_keeps_order(spark):
    df = spark.createDataFrame([("  VNM ", 1, "\tVNM", "")], "ticker string, n int, tab string, empty string")
    out = C.trim_strings(df)
    assert out.columns == df.columns
    assert tuple(one(out)) == ("VNM", 1, "\tVNM", "")


@pytest.mark.parametrize(
    "value,expected",
    [(1.005, D("1.01")), (-1.005, D("-1.01")), (1e30, None), (float("nan"), None), (None, None), (7.0, D("7.00"))],
)
def test_double_to_money_rounds_half_up_or_gives_null(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert one(retype(df, {"x": "decimal(20,2)"}))[0] == expected


@pytest.mark.parametrize(
    "value,expected",
    [("100.0", 100), ("100.9", 100), ("-100.9", -100), ("100", 100), ("abc", None), ("", None), (None, None),
     (" 12 ", 12), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("1e3", 1000),
     ("0.9999999", 0)],
)
def test_text_to_whole_number_cuts_the_fraction(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x string")
    assert one(retype(df, {"x": "bigint"}))[0] == expected


def test_double_to_whole_number(spark):
    df = spark.createDataFrame([(100.9, 1e30)], "a double, b double")
    assert tuple(one(retype(df, {"a": "bigint", "b": "bigint"}))) == (100, None)


def test_whole_number_year_from_text(spark):
    df = spark.createDataFrame([("2015.0",), ("2016",), ("x",)], "year string")
    assert [r[0] for r in retype(df, {"year": "int"}).collect()] == [2015, 2016, None]


def test_times_and_ratios(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05", "bad", "12.34567")], "a string, b string, pe string")
    row = one(retype(df, {"a": "timestamp", "b": "timestamp", "pe": "decimal(20,4)"}))
    assert tuple(row) == (dt.datetime(2024, 1, 2, 3, 4, 5), None, D("12.3457"))


def test_absent_columns_are_skipped_and_names_matched_without_case(spark):
    df = spark.createDataFrame([("1.5",)], "PE string")
    assert has_column(df, "pe") and not has_column(df, "ps")
    out = retype(df, {"pe": "decimal(20,4)", "ps": "decimal(20,4)"})
    assert [c.lower() for c in out.columns] == ["pe"] and one(out)[0] == D("1.5000")


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(" a ", None)], "`x.y z` string, `n.m` int")
    assert tuple(one(C.fill_nulls(C.trim_strings(df)))) == ("a", 0)


def test_fill_by_type(spark):
    schema = (
        "b byte, s short, i int, l long, f float, d double, m decimal(20,2), t string, e string, dd date, "
        "ts timestamp, ntz timestamp_ntz, flag boolean, arr array<int>"
    )
    row = (None,) * 8 + ("",) + (None,) * 5
    out = C.fill_nulls(spark.createDataFrame([row], schema))
    epoch = dt.datetime(1970, 1, 1)
    assert tuple(one(out)) == (0, 0, 0, 0, 0.0, 0.0, D("0.00"), " ", "", epoch.date(), epoch, epoch, False, None)
    assert [f.dataType for f in out.schema] == [f.dataType for f in spark.createDataFrame([row], schema).schema]
    kept = one(C.fill_nulls(spark.createDataFrame([row], schema), numeric=False))
    assert kept["l"] is None and kept["m"] is None and kept["t"] == " "


@pytest.mark.parametrize(
    "text,expected",
    [("31/12/2015", "2015-12-31"), ("2015-12-31", "2015-12-31"), ("2015-12-31 00:00:00", "2015-12-31"),
     ("junk", None), (None, None), ("2015", "2015-01-01"), ("", None)],
)
def test_flexible_date(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x string").select(flexible_date(F.col("x")))
    assert one(df)[0] == expected
    assert df.schema[0].dataType == T.StringType()


def test_buckets_and_keys(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 4, 5, 6, 7, 89000),)], "t timestamp")
    t = F.col("t")
    row = one(df.select(hour_bucket(t), day_key(t), month_key(t), message_stamp(t)))
    assert tuple(row)[:3] == ("2024-03-04_05", "20240304", "202403")
    assert row[3].startswith("06-07-089_") and len(row[3]) == len("06-07-089_") + 8


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2024, 12, 30),)], "d date")
    rows = df.select(*[c.alias(n) for n, c in calendar_parts(F.col("d")).items()]).collect()
    assert rows[0].asDict() == {
        "year": 2023, "quarter": 1, "month": 1, "week": 52, "day_of_month": 1, "day_of_week": 7, "is_weekend": 1
    }
    assert (rows[1]["week"], rows[1]["day_of_week"], rows[1]["is_weekend"]) == (1, 1, 0)


def test_names_tags_and_technical_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "` EV EBITDA` double, PE double")
    tagged = C.tag(C.normalize_names(df), "financial_ratio", "VNM")
    assert tagged.columns == ["ev_ebitda", "pe", "type", "ticker"]
    assert one(tagged)["type"] == "financial_ratio" and one(tagged)["ticker"] == "VNM"
    assert C.drop_technical(tagged).columns == ["ev_ebitda", "pe", "ticker"]
    assert C.drop_technical(df).columns == df.columns


def test_json_row_keeps_scalars_and_nulls(spark):
    df = spark.createDataFrame(
        [("Ä", 1, 2.5, True, None, dt.datetime(2024, 1, 2, 3, 4, 5), D("1.50"))],
        "t string, i int, d double, b boolean, n string, ts timestamp, m decimal(20,2)",
    )
    out = one(C.stringify_complex(df).select(C.json_row(C.stringify_complex(df))))[0]
    assert out == '{"t":"Ä","i":1,"d":2.5,"b":true,"n":null,"ts":"2024-01-02 03:04:05","m":"1.50"}'


def test_default_now(spark):
    given = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(given,), (None,)], "ingested_at timestamp")
    rows = [r[0] for r in C.default_now(df).collect()]
    assert rows[0] == given and rows[1] > given
