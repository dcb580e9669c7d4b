"""Relational tables over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_options(
    url: str,
    table: str,
    properties: Mapping[str, str],
    split_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    splits: int = 1,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Options of a table scan; with a split column it runs as ``splits`` tasks."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **properties}
    if split_column is not None:
        if bounds is None or splits < 2:
            raise ValueError("a split column needs its bounds and at least two splits")
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits),
        }
    return options


def read_table(spark: SparkSession, url: str, table: str, properties: Mapping[str, str], **split) -> DataFrame:
    """A whole table; filters and columns used later are pushed into the query."""
    return spark.read.format("jdbc").options(**read_options(url, table, properties, **split)).load()
