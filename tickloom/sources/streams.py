"""Streams of messages: a broker topic, or files that stand in for one.

Both give a ``value`` column (and ``topic``), so everything downstream is the
same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Messages that one micro-batch takes at most: a first batch from ``earliest`` is not the whole topic.
MOST_OFFSETS = 5_000_000


def broker_options(servers: str, topics: Sequence[str], starting: str, most_offsets: int = MOST_OFFSETS) -> dict[str, str]:
    return {
        "maxOffsetsPerTrigger": str(most_offsets),
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }


def broker_stream(spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "latest") -> DataFrame:
    """Subscribe to topics; needs the broker connector on the class path.

    The tick job starts at ``latest``, the archive job at ``earliest``.
    """
    return spark.readStream.format("kafka").options(**broker_options(servers, topics, starting)).load()


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """One message per line; ``topic=<name>`` folders become a ``topic`` column."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def decode(messages: DataFrame) -> DataFrame:
    """Message bytes as UTF-8 text, the topic kept where there is one."""
    rest = [c for c in ("topic",) if c in messages.columns]
    return messages.select(F.col("value").cast("string").alias("value"), *rest)
