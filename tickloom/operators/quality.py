"""Batch quality: one pass over the rows, one verdict per ticker."""

from __future__ import annotations

import logging
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.casts import quoted, same_key
from tickloom.sources.lake import KEYS
from tickloom.specs import QUALITY, QualitySpec

logger = logging.getLogger(__name__)

_KIND_OF = (
    (T.IntegralType, "i"),
    (T.FloatType, "f"),
    (T.DoubleType, "f"),
    (T.BooleanType, "b"),
    (T.TimestampType, "M"),
    (T.TimestampNTZType, "M"),
)


def kind_of(data_type: T.DataType) -> str:
    """Kind letter of a column type; everything unlisted counts as object."""
    return next((kind for cls, kind in _KIND_OF if isinstance(data_type, cls)), "O")


def missing_columns(df: DataFrame, spec: QualitySpec) -> list[str]:
    return [c for c in spec.required if c not in df.columns]


def type_errors(df: DataFrame, spec: QualitySpec) -> list[str]:
    """Columns whose kind is not accepted; absent columns are not judged here."""
    return [
        c for c, kinds in spec.kinds.items() if c in df.columns and kind_of(df.schema[c].dataType) not in kinds
    ]


def _is_missing(df: DataFrame, name: str) -> Column:
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _count_where(condition: Column) -> Column:
    # A null condition (unparseable or missing value) does not count.
    return F.count(F.when(condition, F.lit(1)))


def _checks(df: DataFrame, spec: QualitySpec) -> list[tuple[str, str, Column]]:
    """(check, column, count) for everything the batch is measured on."""
    whole = F.count(F.lit(1))
    checks = [("missing_column", c, whole) for c in missing_columns(df, spec)]
    if KEYS in df.columns:
        # Records tell which fields they carry: a ticker none of whose records has a column lacks it, whatever others have.
        here = [c for c in spec.required if c in df.columns and c != "ticker"]
        checks += [("missing_column", c, F.when(F.max(F.array_contains(KEYS, c)), F.lit(0)).otherwise(whole)) for c in here]
    checks += [("type_error", c, whole) for c in type_errors(df, spec)]
    checks += [("null_violation", c, _count_where(_is_missing(df, c))) for c in spec.not_null if c in df.columns]
    for name, (low, high) in spec.ranges.items():
        if name not in df.columns:
            continue
        number = quoted(name).try_cast("double")
        if low is not None:
            checks.append(("below_min", name, _count_where(number < F.lit(float(low)))))
        if high is not None:
            # NaN sorts above every number but breaks no bound.
            checks.append(("above_max", name, _count_where((number > F.lit(float(high))) & ~F.isnan(number))))
    return checks


_REPORT = "topic string, ticker string, check string, column string, count bigint"


def _counted(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per ticker with the count of each check, from a single pass."""
    ticker = quoted("ticker").cast("string") if "ticker" in df.columns else F.lit(None).cast("string")
    return df.groupBy(ticker.alias("ticker")).agg(*[n.alias(f"_n{i}") for i, (_, _, n) in enumerate(checks)])


def quality_report(df: DataFrame, topic: str) -> DataFrame:
    """One row per ticker, check and column that failed; empty means valid.

    Missing or mistyped columns concern the whole frame and are charged to every
    ticker with its row count. A topic without rules passes.
    """
    spec = QUALITY.get(topic)
    if spec is None:
        logger.warning("no quality rules for topic %s, nothing checked", topic)
        return df.sparkSession.createDataFrame([], _REPORT)
    checks = _checks(df, spec)
    findings = F.array(
        *[
            F.struct(F.lit(check).alias("check"), F.lit(name).alias("column"), F.col(f"_n{i}").alias("count"))
            for i, (check, name, _) in enumerate(checks)
        ]
    )
    return (
        _counted(df, checks)
        .select("ticker", F.inline(findings))
        .where("count > 0")
        .select(F.lit(topic).alias("topic"), "ticker", "check", "column", "count")
    )


def batch_sizes(df: DataFrame) -> DataFrame:
    """Rows per ticker and columns of the frame, for the quality log."""
    return df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def failing_tickers(df: DataFrame, topic: str) -> DataFrame:
    """Tickers with at least one finding, each once."""
    checks = _checks(df, QUALITY[topic])
    found = reduce(or_, [F.col(f"_n{i}") > 0 for i in range(len(checks))])
    return _counted(df, checks).where(found).select(F.col("ticker").alias("_failing"))


def fails_as_a_whole(df: DataFrame, topic: str) -> bool:
    """Whether the schema alone withholds every ticker."""
    spec = QUALITY.get(topic)
    return spec is not None and bool(missing_columns(df, spec) or type_errors(df, spec))


def split_by_quality(df: DataFrame, topic: str, failing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may land, rows held back).

    A ticker with any finding is held back whole, not only its bad rows. Pass
    ``failing`` (see ``failing_tickers``) to use a list that is kept elsewhere.
    """
    if topic not in QUALITY:
        return df, df.where(F.lit(False))
    if fails_as_a_whole(df, topic):
        return df.where(F.lit(False)), df
    failing = failing_tickers(df, topic) if failing is None else failing
    same = same_key("ticker", "_failing")
    return df.join(failing, same, "left_anti"), df.join(failing, same, "left_semi")


def quality_counts(df: DataFrame, topic: str, hour: Column) -> DataFrame:
    """The counts of every check by hour and ticker, to be kept: ``topic, dt_hour, ticker, check, column, count``.

    The check ``rows`` counts the rows themselves. Counts of several hours, or of several parts of one, add up, so a verdict over many
    hours needs no row again. Only counts above zero are kept, and the rows.
    """
    spec = QUALITY.get(topic, QualitySpec())
    checks = [("rows", "", F.count(F.lit(1))), *_checks(df, spec)]
    ticker = quoted("ticker").cast("string") if "ticker" in df.columns else F.lit(None).cast("string")
    counts = df.groupBy(hour.alias("dt_hour"), ticker.alias("ticker")).agg(*[n.alias(f"_n{i}") for i, (_, _, n) in enumerate(checks)])
    findings = F.array(
        *[F.struct(F.lit(check).alias("check"), F.lit(name).alias("column"), F.col(f"_n{i}").alias("count")) for i, (check, name, _) in enumerate(checks)]
    )
    return counts.select(F.lit(topic).alias("topic"), "dt_hour", "ticker", F.inline(findings)).where("count > 0")


def rolled_up(counts: DataFrame) -> DataFrame:
    """Counts over all hours of ``counts``, as one report by ticker, check and column."""
    return counts.groupBy("topic", "ticker", "check", "column").agg(F.sum("count").alias("count"))


def failing_by_counts(counts: DataFrame) -> DataFrame:
    """The tickers that kept counts withhold, for ``split_by_quality``; reads no row of the feed."""
    return counts.where(F.col("check") != "rows").select(F.col("ticker").alias("_failing")).distinct()
