"""Versioned rows and validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.casts import quoted
from tickloom.operators.ordered import number_rows


def version_history(
    df: DataFrame, keys: Sequence[str], created_at: str, tie_break: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Number every row of a key by age, oldest first, as ``version``."""
    return number_rows(df, keys, [created_at, *tie_break], "version", ranges=ranges)


def validity_intervals(
    df: DataFrame, keys: Sequence[str], valid_from: str, tie_break: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Type-2 history: ``version``, ``valid_to`` (open end is null), ``is_current``.

    Rows of a key with equal ``valid_from`` need a ``tie_break`` that orders them, or
    their versions are arbitrary; reduce them to one row first where only one is valid.
    """
    numbered = number_rows(df, keys, [valid_from, *tie_break], "version", {"valid_to": valid_from}, ranges)
    return numbered.withColumn("is_current", F.col("valid_to").isNull())


def continue_history(open_rows: DataFrame, later: DataFrame, keys: Sequence[str], valid_from: str) -> DataFrame:
    """What rows later than the open ones change in a type-2 history: the open rows, closed, and the new ones.

    ``open_rows`` has the columns of ``later`` and ``version``, one row for each key at most; ``later`` has one row for each
    (key, ``valid_from``), none older than the key's open row. Versions go on from the open row's. A row with the open
    row's own ``valid_from`` takes its place and its version. Keys without later rows do not come out. What a key gets
    at once must be few rows, such as one a day.
    """
    touched = later.select(*[quoted(k).alias(f"_{k}") for k in keys]).distinct()
    same = [quoted(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    known = open_rows.join(touched, same, "left_semi").withColumn("_new", F.lit(0))
    both = known.unionByName(later.withColumns({"version": F.lit(None).cast("bigint"), "_new": F.lit(1)}))
    along = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(quoted(valid_from), "_new")
    to_here = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*[quoted(k) for k in keys])
    # The new rows that come after the open one's day, so far.
    began = F.max(F.when(F.col("_new") == 0, quoted(valid_from))).over(whole)
    step = F.when((F.col("_new") == 1) & (began.isNull() | (quoted(valid_from) > began)), 1).otherwise(0)
    numbered = both.withColumn("_step", step).withColumns(
        {
            "_version": F.coalesce(F.max("version").over(whole), F.lit(0)) + F.sum("_step").over(to_here),
            "valid_to": F.lead(quoted(valid_from)).over(along),
        }
    )
    # The open row that a row of its own day replaces would be an empty interval.
    kept = numbered.where(F.col("valid_to").isNull() | (F.col("valid_to") > quoted(valid_from)))
    out = kept.withColumn("version", F.col("_version").cast("bigint")).withColumn("is_current", F.col("valid_to").isNull())
    return out.drop("_new", "_step", "_version")
