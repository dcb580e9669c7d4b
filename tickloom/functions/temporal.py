"""Dates, hour buckets, calendar parts and partition keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms shared with the existing lake and tables.
HOUR_BUCKET = "yyyy-MM-dd_HH"
MINUTE_STAMP = "mm-ss-SSS"
DAY_FIRST = "dd/MM/yyyy"
ISO_DAY = "yyyy-MM-dd"
DAY_KEY = "yyyyMMdd"
MONTH_KEY = "yyyyMM"


def flexible_date(text: Column) -> Column:
    """Day-first, then ISO, then anything Spark reads as a date; ISO text out."""
    return F.coalesce(
        F.try_to_date(text, DAY_FIRST),
        F.try_to_date(text, ISO_DAY),
        text.try_cast("date"),
    ).cast("string")


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, HOUR_BUCKET)


def message_stamp(ts: Column) -> Column:
    """Minute-second-milli plus eight random characters, unique per message."""
    return F.concat_ws("_", F.date_format(ts, MINUTE_STAMP), F.substring(F.uuid(), 1, 8))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, DAY_KEY)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, MONTH_KEY)


def calendar_parts(day: Column) -> dict[str, Column]:
    """The attributes of the calendar dimension; weeks are ISO, Monday is 1."""
    iso_day = F.weekday(day) + F.lit(1)
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "week": F.weekofyear(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": iso_day,
        "is_weekend": F.when(iso_day >= 6, 1).otherwise(0),
    }
