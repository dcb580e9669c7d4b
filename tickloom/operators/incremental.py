"""Date ranges and per-ticker high-water marks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.functions.casts import quoted, same_key
from tickloom.specs import BACKFILL_START, LOOKBACK_DAYS


def _day(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def between_days(df: DataFrame, time_col: str, first: str | dt.date, last: str | dt.date) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``.

    The bounds are literals of the column's own type: no cast stands on the
    column, so the range reaches the file scan.
    """
    data_type = df.schema[time_col].dataType
    start, stop = _day(first), _day(last) + dt.timedelta(days=1)
    if isinstance(data_type, T.StringType):
        raise TypeError(f"{time_col} must be typed before it is compared")

    def bound(day: dt.date) -> Column:
        return F.lit(day.isoformat()).cast(data_type)

    return df.where((quoted(time_col) >= bound(start)) & (quoted(time_col) < bound(stop)))


def lookback(df: DataFrame, time_col: str, as_of: str | dt.date, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The last ``days`` days up to and including ``as_of``."""
    last = _day(as_of)
    return between_days(df, time_col, last - dt.timedelta(days=days), last)


def backfill_range(df: DataFrame, time_col: str, as_of: str | dt.date, start: str = BACKFILL_START) -> DataFrame:
    """Everything from the fixed history start to ``as_of``."""
    return between_days(df, time_col, start, as_of)


def high_water(df: DataFrame, time_col: str = "time", key: str = "ticker") -> DataFrame:
    """Latest time seen per ticker."""
    return df.groupBy(key).agg(F.max(time_col).alias("last_time"))


def newer_than(df: DataFrame, marks: DataFrame, time_col: str = "time", key: str = "ticker", bucketed: bool = False) -> DataFrame:
    """Rows strictly newer than their ticker's mark; unseen tickers pass whole.

    Rows without ticker have no mark to be held against and never pass. ``bucketed`` if both sides are
    tables in the same buckets of ``key``: they are then joined as they lie.
    """
    df = df.where(quoted(key).isNotNull())
    known = marks.where(quoted(key).isNotNull()).select(quoted(key).alias("_marked"), "last_time")
    return (
        df.join(known, quoted(key) == F.col("_marked") if bucketed else same_key(key, "_marked"), "left")
        .where(F.col("last_time").isNull() | (F.col(time_col) > F.col("last_time")))
        .drop("_marked", "last_time")
    )


def first_of_polls(df: DataFrame, poll: str, time_col: str = "time", key: str = "ticker") -> DataFrame:
    """Rows of several polls that are newer than all earlier polls of their ticker.

    Polls overlap; a row counts in the first poll that holds its time. Ticks of one poll with
    the same time all stay. One small row per ticker and poll carries the time so far.
    """
    newest = df.groupBy(quoted(key), quoted(poll)).agg(F.max(time_col).alias("_newest"))
    earlier = Window.partitionBy(quoted(key)).orderBy(quoted(poll)).rowsBetween(Window.unboundedPreceding, -1)
    marks = newest.select(quoted(key).alias("_marked"), quoted(poll).alias("_poll"), F.max("_newest").over(earlier).alias("last_time"))
    same = (F.struct(quoted(key).alias("k"), quoted(poll).alias("p")) == F.struct(F.col("_marked").alias("k"), F.col("_poll").alias("p")))
    fresh = df.join(marks, same, "left").where(F.col("last_time").isNull() | (F.col(time_col) > F.col("last_time")))
    return fresh.drop("_marked", "_poll", "last_time")


def advance_marks(marks: DataFrame, accepted: DataFrame, time_col: str = "time", key: str = "ticker") -> DataFrame:
    """The marks after the accepted rows have been sent."""
    both = marks.select(key, "last_time").unionByName(high_water(accepted, time_col, key))
    return both.groupBy(key).agg(F.max("last_time").alias("last_time"))
