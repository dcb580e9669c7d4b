"""Derived tables: calendar, star queries, company history, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.temporal import calendar_parts
from tickloom.operators.history import continue_history, validity_intervals
from tickloom.operators.indicators import moving_indicators
from tickloom.operators.latest import one_per_key
from tickloom.sinks.tables import publish, read_loads
from tickloom.specs import TABLES

SHORT_SMA, SHORT_RSI = 10, 3  # days of the daily indicators
LONG_SMA, LONG_RSI = 200, 14  # of the historical ones


def calendar(dates: DataFrame, column: str = "date_id") -> DataFrame:
    """One row per day between the first and the last date found.

    The size is bounded by the length of the calendar, not by the facts.
    """
    span = dates.agg(F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("date_id"))
    return days.select("date_id", *[part.alias(name) for name, part in calendar_parts(F.col("date_id")).items()])


def company_history(snapshots: DataFrame, ranges: int | None = None) -> DataFrame:
    """Type-2 history of company snapshots by ``as_of_date``.

    Of several snapshots of one company and day the greatest row counts, so that
    versions are reproducible and no interval is empty.
    """
    daily = one_per_key(snapshots, ["ticker", "as_of_date"])
    return validity_intervals(daily, ["ticker"], "as_of_date", ranges=ranges)


def publish_company_history(snapshots: DataFrame, root: str, batch_id: int) -> int:
    """Write the history as a load: a snapshot's newest interval is the one readers see."""
    history = company_history(snapshots).withColumnRenamed("as_of_date", "valid_from")
    rows = publish(history, root, "dim_company_history", batch_id)
    _publish_open(snapshots.sparkSession, root, batch_id)
    return rows


def _publish_open(spark: SparkSession, root: str, batch_id: int) -> None:
    """Keep the open intervals of a load in a table of their own, one row per company."""
    written = read_loads(spark, f"{root}/dim_company_history", TABLES["dim_company_history"]).where(F.col("batch_id") == batch_id)
    publish(written.where("is_current").drop("batch_id"), root, "dim_company_open", batch_id)


def append_company_history(snapshots: DataFrame, root: str, batch_id: int) -> int:
    """Merge new snapshots into the published history; gives the number of rows written.

    Of the history only the open intervals are read, a row per company: they are closed, and versions go on from
    theirs. Companies with a snapshot from before their open interval are numbered anew from their published
    rows; only for them is the history read. Writing a load again decides as the first time, as long as no later one exists.
    """
    spark, spec = snapshots.sparkSession, TABLES["dim_company_history"]
    later = one_per_key(snapshots.withColumnRenamed("as_of_date", "valid_from"), ["ticker", "valid_from"])
    loads = read_loads(spark, f"{root}/dim_company_open", TABLES["dim_company_open"]).where(F.col("batch_id") < batch_id)
    columns = [c for c in later.columns if c in loads.columns]
    later = later.select(*columns)
    known = one_per_key(loads, ["ticker"], ("batch_id",)).select(*columns, "version")
    began = known.select(F.col("ticker").alias("_ticker"), F.col("valid_from").alias("_began"))
    late = later.join(began, F.col("ticker") == F.col("_ticker")).where("valid_from < _began").select("ticker").distinct()
    changed = continue_history(known.join(late, "ticker", "left_anti"), later.join(late, "ticker", "left_anti"), ["ticker"], "valid_from")
    if not late.isEmpty():
        before = read_loads(spark, f"{root}/dim_company_history", spec).where(F.col("batch_id") < batch_id)
        before = one_per_key(before.join(late, "ticker", "left_semi"), ["ticker", "valid_from"], ("batch_id",)).select(*columns, F.lit(0).alias("_load"))
        again = one_per_key(before.unionByName(later.join(late, "ticker", "left_semi").withColumn("_load", F.lit(1))), ["ticker", "valid_from"], ("_load",))
        changed = changed.unionByName(validity_intervals(again.drop("_load"), ["ticker"], "valid_from"))
    rows = publish(changed, root, "dim_company_history", batch_id)
    _publish_open(spark, root, batch_id)
    return rows


def long_term_indicators(daily: DataFrame) -> DataFrame:
    """RSI(14) and SMA(200) over the full history of daily bars."""
    return moving_indicators(daily, sma=(LONG_SMA,), rsi=(LONG_RSI,), one_per_day=True)


def short_term_indicators(daily: DataFrame) -> DataFrame:
    """RSI(3) and SMA(10) of daily bars, refreshed every day."""
    return moving_indicators(daily, sma=(SHORT_SMA,), rsi=(SHORT_RSI,), one_per_day=True)


def newer_indicators(daily: DataFrame, since: Column) -> DataFrame:
    """``short_term_indicators`` of the days from ``since`` on.

    Of older days only the last rows of each ticker that a window reaches back to are kept, so
    an append reads the new days and the table's last partitions (filter ``daily`` to them), not the history.
    """
    reach = max(SHORT_SMA - 1, SHORT_RSI)
    back = Window.partitionBy("ticker").orderBy(F.col("time").desc())
    older = daily.where(F.col("time") < since).withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= reach)
    return short_term_indicators(older.drop("_back").unionByName(daily.where(F.col("time") >= since))).where(F.col("time") >= since)


def stamp_calculation(df: DataFrame) -> DataFrame:
    """Version column of the indicator tables."""
    return df.withColumn("calculated_at", F.current_timestamp())


def publish_calendar(facts: DataFrame, root: str, batch_id: int) -> int:
    """Write the calendar of the facts' dates."""
    return publish(calendar(facts), root, "dim_date", batch_id)


def _indicator_tables(long_term: bool) -> tuple[str, int]:
    """Table, and how many older rows of a ticker a new one's windows reach back to."""
    if long_term:
        return "technical_indicators_historical", max(LONG_SMA - 1, LONG_RSI)
    return "technical_indicators_daily", max(SHORT_SMA - 1, SHORT_RSI)


def _tail_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/tails/{table}"


def last_closes(daily: DataFrame, reach: int) -> DataFrame:
    """``ticker, latest, closes``: the last ``reach`` closes of each ticker, oldest first."""
    back = Window.partitionBy("ticker").orderBy(F.col("time").desc())
    rows = daily.select("ticker", "time", "close").withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= reach)
    grouped = rows.groupBy("ticker").agg(F.max("time").alias("latest"), F.sort_array(F.collect_list(F.struct("time", "close"))).alias("closes"))
    return grouped.select("ticker", "latest", "closes")


def publish_indicators(daily: DataFrame, root: str, batch_id: int, long_term: bool = False) -> int:
    """Calculate and write one of the indicator tables from the whole history, and the tail that appends go on from.

    A recalculation is another load: the newest ``calculated_at`` of a ticker and
    time is the row that readers see.
    """
    table, reach = _indicator_tables(long_term)
    made = long_term_indicators(daily) if long_term else short_term_indicators(daily)
    rows = publish(stamp_calculation(made), root, table, batch_id)
    publish(last_closes(daily, reach), _tail_path(root, table), "indicator_tail", batch_id)
    return rows


def appended_indicators(tail: DataFrame, days: DataFrame, long_term: bool = False) -> DataFrame:
    """Indicators of ``days`` that follow the closes of ``tail``; nothing older is read."""
    older = tail.select("ticker", F.inline("closes")).join(days.select("ticker").distinct(), "ticker", "left_semi")
    older = older.withColumns({"_own": F.lit(False), **{c: F.lit(None).cast(days.schema[c].dataType) for c in days.columns if c not in older.columns}})
    both = older.unionByName(days.withColumn("_own", F.lit(True)))
    made = long_term_indicators(both) if long_term else short_term_indicators(both)
    return made.where("_own").drop("_own")


def append_indicators(days: DataFrame, root: str, batch_id: int, long_term: bool = False, history: DataFrame | None = None) -> int:
    """Calculate and write the indicators of new days from the published tail; gives the number of rows.

    The tail of all loads before this one has a row per ticker: an append reads it and the new days. Tickers with a day
    no newer than their tail are calculated anew from ``history``, which must hold the new days too and is read for them only; without it such
    days are refused. Writing a load again decides as the first time.
    """
    spark = days.sparkSession
    table, reach = _indicator_tables(long_term)
    loads = read_loads(spark, f"{_tail_path(root, table)}/indicator_tail", TABLES["indicator_tail"])
    tail = one_per_key(loads.where(F.col("batch_id") < batch_id), ["ticker"], ("batch_id",)).drop("batch_id")
    known = tail.select(F.col("ticker").alias("_ticker"), "latest")
    late = days.join(known, F.col("ticker") == F.col("_ticker")).where(F.col("time") <= F.col("latest")).select("ticker").distinct()
    made, closes = appended_indicators(tail, days, long_term), days.select("ticker", "time", "close")
    if not late.isEmpty():
        if history is None:
            raise ValueError("some days are not newer than the published ones: pass the history")
        again = history.join(late, "ticker", "left_semi")
        made = appended_indicators(tail, days.join(late, "ticker", "left_anti"), long_term)
        made = made.unionByName((long_term_indicators(again) if long_term else short_term_indicators(again)).select(*made.columns))
        closes = closes.join(late, "ticker", "left_anti").unionByName(again.select("ticker", "time", "close"))
        tail = tail.join(late, "ticker", "left_anti")
    rows = publish(stamp_calculation(made), root, table, batch_id)
    older = tail.select("ticker", F.inline("closes")).join(closes.select("ticker").distinct(), "ticker", "left_semi")
    publish(last_closes(older.unionByName(closes), reach), _tail_path(root, table), "indicator_tail", batch_id)
    return rows
