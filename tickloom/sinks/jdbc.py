"""Appending to relational and columnar warehouses over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# Driver settings of the two targets.
WAREHOUSE = {
    "driver": "com.clickhouse.jdbc.ClickHouseDriver",
    "batchsize": "100000",
    "rewrite_batch_insert": "true",
    "socket_timeout": "300000",
    "connection_timeout": "300000",
    "compress": "0",
    "isolationLevel": "NONE",
}
STAGING = {
    "driver": "org.postgresql.Driver",
    "batchsize": "10000",
    "rewriteBatchedStatements": "true",
}


def write_options(
    url: str, table: str, preset: Mapping[str, str], user: str, password: str, connections: int
) -> dict[str, str]:
    return {
        **preset,
        "url": url,
        "dbtable": table,
        "user": user,
        "password": password,
        # Spark merges down to this many tasks, each with one open connection.
        "numPartitions": str(connections),
    }


def append_table(
    df: DataFrame,
    url: str,
    table: str,
    preset: Mapping[str, str],
    user: str = "",
    password: str = "",
    connections: int = 32,
    mode: str = "append",
) -> None:
    """Write ``df``; a retried task may repeat rows, which the keyed table absorbs."""
    options = write_options(url, table, preset, user, password, connections)
    df.write.format("jdbc").mode(mode).options(**options).save()
