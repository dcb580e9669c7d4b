"""Whole-frame projections driven by the schema, each a single ``select``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.casts import quoted

# What a missing value is replaced with, by type.
FILL_WHOLE = 0
FILL_FRACTION = 0.0
FILL_TEXT = " "
FILL_DATE = "1970-01-01"
FILL_TIMESTAMP = "1970-01-01 00:00:00"
FILL_FLAG = False

# Bookkeeping columns of the raw records, never published.
TECHNICAL_COLUMNS = ("type", "kafka_ingested_at", "dt_hour")

_PRIMITIVE = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.NullType)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip blanks (only blanks, not tabs) around every top-level string."""
    return df.select(
        *[
            F.trim(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def _default_for(data_type: T.DataType) -> Column | None:
    if isinstance(data_type, T.IntegralType):
        value = FILL_WHOLE
    elif isinstance(data_type, (T.FractionalType, T.DecimalType)):
        value = FILL_FRACTION
    elif isinstance(data_type, T.StringType):
        value = FILL_TEXT
    elif isinstance(data_type, T.DateType):
        value = FILL_DATE
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        value = FILL_TIMESTAMP
    elif isinstance(data_type, T.BooleanType):
        value = FILL_FLAG
    else:
        return None
    return F.lit(value).cast(data_type)


def fill_nulls(df: DataFrame, numeric: bool = True) -> DataFrame:
    """Replace nulls by the default of the column's type.

    ``numeric=False`` leaves numbers null, for tables in which an unknown number
    must not be mistaken for zero.
    """
    out = []
    for f in df.schema.fields:
        default = _default_for(f.dataType)
        if default is None or (not numeric and isinstance(f.dataType, T.NumericType)):
            out.append(quoted(f.name))
        else:
            out.append(F.coalesce(quoted(f.name), default).alias(f.name))
    return df.select(*out)


def drop_technical(df: DataFrame) -> DataFrame:
    return df.drop(*TECHNICAL_COLUMNS)


def tag(df: DataFrame, topic: str, ticker: str | None = None) -> DataFrame:
    """Add the topic name, and the ticker where the frame holds only one."""
    labels = {"type": F.lit(topic)}
    if ticker is not None:
        labels["ticker"] = F.lit(ticker)
    return df.withColumns(labels)


def normalized_name(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_")


def normalize_names(df: DataFrame) -> DataFrame:
    """``"EV EBITDA "`` -> ``ev_ebitda`` for every column."""
    return df.toDF(*[normalized_name(c) for c in df.columns])


def stringify_complex(df: DataFrame) -> DataFrame:
    """Turn every value a JSON scalar cannot hold as is into its text."""
    return df.select(
        *[
            quoted(f.name) if isinstance(f.dataType, _PRIMITIVE) else quoted(f.name).cast("string").alias(f.name)
            for f in df.schema.fields
        ]
    )


def json_row(df: DataFrame) -> Column:
    """One JSON object per row; null fields are written, not left out."""
    return F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})


def default_now(df: DataFrame, column: str = "ingested_at") -> DataFrame:
    """Column default: the load time where the source gave none."""
    return df.withColumn(column, F.coalesce(F.col(column), F.current_timestamp()))
