"""Validated landing of fetched frames, and publishing of new ticks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import normalize_names, tag
from tickloom.operators.incremental import advance_marks, newer_than
from tickloom.operators.quality import failing_tickers, fails_as_a_whole, split_by_quality
from tickloom.sinks.lake import write_records
from tickloom.sinks.messages import encode
from tickloom.specs import INDEX_LABELS, QUALITY


def relabel_index(df: DataFrame, column: str = "ticker") -> DataFrame:
    """Store index symbols under their table names; other symbols are kept."""
    label = F.col(column)
    for symbol, stored in INDEX_LABELS.items():
        label = F.when(F.col(column) == symbol, F.lit(stored)).otherwise(label)
    return df.withColumn(column, label)


def ticker_rows(symbols: DataFrame, group: str, topic: str = "ticker_list") -> DataFrame:
    """(ticker, group, type) rows from a frame with one ``symbol`` column."""
    return symbols.select(
        F.col("symbol").alias("ticker"), F.lit(group).alias("group"), F.lit(topic).alias("type")
    )


def prepare(df: DataFrame, topic: str) -> DataFrame:
    """Clean column names and tag the topic, as every fetch does."""
    return tag(normalize_names(df), topic)


@dataclass(frozen=True)
class Landing:
    accepted: DataFrame
    held_back: DataFrame


def validate(df: DataFrame, topic: str) -> Landing:
    """Split a prepared frame at the quality gate."""
    return Landing(*split_by_quality(df, topic))


def land(
    df: DataFrame, topic: str, lake_root: str, hour: str | None = None, quarantine_root: str | None = None
) -> bool:
    """Write the accepted tickers to the lake, the others to quarantine.

    True if anything landed. The list of failing tickers, a row per ticker at
    most, is kept for both writes, so the rows are judged once.
    """
    prepared = prepare(df, topic)
    failing = None
    if topic in QUALITY and not fails_as_a_whole(prepared, topic):
        failing = failing_tickers(prepared, topic).persist()
    accepted, held_back = split_by_quality(prepared, topic, failing)
    if quarantine_root is not None:
        write_records(held_back, quarantine_root, topic, hour)
    landed = write_records(accepted, lake_root, topic, hour)
    if failing is not None:
        failing.unpersist()
    return landed


def new_tick_messages(polled: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages for ticks newer than the marks, the marks afterwards).

    Both results read ``polled``, so it must be stable: a table, not a live feed.
    """
    fresh = newer_than(polled, marks)
    return encode(fresh), advance_marks(marks, fresh)
