"""Casts that turn bad values into null while ANSI mode stays on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(20,2)"
RATIO = "decimal(20,4)"


def quoted(name: str) -> Column:
    """Reference a column whose name may hold dots, blanks or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def same_key(left: str, right: str) -> Column:
    """Equality of two key columns (null equals null) that lets Spark split hot keys.

    The small side of such a join usually comes out of an aggregation by the same
    key. Compared directly, it would be joined in that very partitioning, and
    adaptive execution only splits inputs that were shuffled for the join itself.
    Comparing one-field structs asks for that shuffle; the small side pays for it.
    """
    return F.struct(quoted(left).alias("k")) == F.struct(quoted(right).alias("k"))


def cast_or_null(column: Column, source: T.DataType, target: str) -> Column:
    """Cast ``column`` to ``target``; what does not fit becomes null.

    Text such as ``"100.0"`` is a legal whole number in the raw feeds, but a
    direct text-to-integer ``try_cast`` rejects it. It goes through a decimal
    wide enough for every 64-bit integer, and the fraction is then cut off.
    (Exponent notation, ``"1e3"``, is accepted by this route as well.)
    """
    if target in ("int", "bigint") and isinstance(source, T.StringType):
        return column.try_cast("decimal(38,18)").try_cast(target)
    return column.try_cast(target)


def present_columns(df: DataFrame) -> dict[str, str]:
    """Lower-case name -> actual name."""
    return {name.lower(): name for name in df.columns}


def has_column(df: DataFrame, name: str) -> bool:
    """Case-insensitive existence test, answered from the schema alone."""
    return name.lower() in present_columns(df)


def retype(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Cast the listed columns in one projection; absent columns are skipped."""
    actual = present_columns(df)
    return df.withColumns(
        {
            name: cast_or_null(quoted(actual[name]), df.schema[actual[name]].dataType, target)
            for name, target in targets.items()
            if name in actual
        }
    )
