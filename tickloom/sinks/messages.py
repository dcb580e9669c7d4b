"""Rows as keyed JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import json_row, stringify_complex


def encode(df: DataFrame, key: str = "ticker") -> DataFrame:
    """``key`` and JSON ``value`` columns, ready for a broker."""
    scalar = stringify_complex(df)
    return scalar.select(F.col(key).cast("string").alias("key"), json_row(scalar).alias("value"))


def publish(messages: DataFrame, servers: str, topic: str, linger_ms: int = 5) -> None:
    """Send encoded rows to a topic; needs the broker connector on the class path."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.linger.ms", linger_ms)
        .option("topic", topic)
        .save()
    )
