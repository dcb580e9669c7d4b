"""Membership and star joins.

No join here forces a broadcast: a dimension grows with the market, so the
choice is left to the planner, which broadcasts below its size threshold (also
re-measured at run time) and otherwise shuffles and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tickloom.functions.casts import quoted, same_key


def _same(left: str, right: str, bucketed: bool) -> Column:
    # Buckets are found by the columns themselves; unbucketed sides are shuffled so that hot keys can be split.
    return quoted(left) == quoted(right) if bucketed else same_key(left, right)


def members_only(df: DataFrame, members: DataFrame, on: str = "ticker", bucketed: bool = False) -> DataFrame:
    """Rows whose ticker belongs to the group; ``bucketed`` if both sides are tables in the same buckets of ``on``."""
    listed = members.where(quoted(on).isNotNull()).select(quoted(on).alias("_member"))
    return df.join(listed, _same(on, "_member", bucketed), "left_semi")


def with_calendar(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Attach the calendar attributes of each row's ``date_id``."""
    return fact.join(dim_date, "date_id", "inner")


def with_dimension(fact: DataFrame, dim: DataFrame, on: str = "ticker", bucketed: bool = False) -> DataFrame:
    """Attach a dimension; facts without a match are kept. ``bucketed`` as for ``members_only``."""
    keyed = dim.where(quoted(on).isNotNull()).withColumnRenamed(on, "_dimension_key")
    return fact.join(keyed, _same(on, "_dimension_key", bucketed), "left").drop("_dimension_key")
