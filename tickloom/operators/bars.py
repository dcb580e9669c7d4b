"""OHLCV bars from trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ohlcv(price: str, volume: str, time: str, tie_break: Sequence[str]) -> list[Column]:
    if tie_break:
        trade = F.struct(time, *tie_break, F.col(price).alias("_price"))
        first, last = F.min(trade).getField("_price"), F.max(trade).getField("_price")
    else:
        # One row per (ticker, time): the time alone orders the trades, and all
        # buffers are fixed-width, which keeps the plan a hash aggregate.
        first, last = F.min_by(price, time), F.max_by(price, time)
    return [
        first.alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        last.alias("close"),
        F.sum(volume).alias("volume"),
    ]


def intraday_bars(
    df: DataFrame,
    width: str = "5 minutes",
    price: str = "price",
    volume: str = "volume",
    time: str = "time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Bars of a fixed width per ticker; ``time`` is the start of the bar."""
    return (
        df.groupBy("ticker", F.window(F.col(time), width).getField("start").alias("_start"))
        .agg(*_ohlcv(price, volume, time, tie_break))
        .withColumnRenamed("_start", "time")
    )


def daily_bars(
    df: DataFrame,
    price: str = "price",
    volume: str = "volume",
    time: str = "time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One bar per ticker and day."""
    return df.groupBy("ticker", F.to_date(time).alias("date_id")).agg(*_ohlcv(price, volume, time, tie_break))


def stream_bars(
    df: DataFrame,
    width: str = "5 minutes",
    delay: str = "10 minutes",
    price: str = "price",
    volume: str = "volume",
    time: str = "time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """``intraday_bars`` of a stream: a bar comes out once, when no tick up to ``delay`` late can change it.

    State holds the open bars only. Later ticks than that are left out, so ``delay`` must cover the feed.
    """
    bars = df.withWatermark(time, delay).groupBy("ticker", F.window(F.col(time), width).alias("_window"))
    made = bars.agg(*_ohlcv(price, volume, time, tie_break))
    return made.select("ticker", *[F.col(c) for c in ("open", "high", "low", "close", "volume")], F.col("_window.start").alias("time"))
