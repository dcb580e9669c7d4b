"""Tables bucketed by key, so that joins by it need no shuffle.

Facts, dimensions and marks written with the same number of buckets meet bucket by bucket: what a shuffle would do
at every join is done once, at the write. The price is that adaptive execution cannot split a hot
key, since nothing is shuffled: for feeds with such keys join unbucketed tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str] = ("ticker",), buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` to ``path`` in buckets of ``keys``, sorted by them inside, and read it back."""
    first, *rest = keys
    # One task for each bucket writes one file; without it every task would write one file into every bucket.
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, first, *rest).sortBy(first, *rest).option("path", path).format("parquet").saveAsTable(_name(path))
    return df.sparkSession.table(_name(path))


def read_bucketed(spark: SparkSession, path: str, ddl: str, keys: Sequence[str] = ("ticker",), buckets: int = BUCKETS) -> DataFrame:
    """A table that ``write_bucketed`` wrote, in whatever session; columns, keys and buckets must be those it was written with."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        by = ", ".join(f"`{k}`" for k in keys)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)
