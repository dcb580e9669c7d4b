"""Raw records into the lake, as JSON lines grouped by topic and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.counting import counted, rows_written
from tickloom.session import shuffles_dropped
from tickloom.sources.lake import topic_path

PACKED_ROWS = 1_000_000  # in a compressed file at most: it can't be split when it is read


def write_records(
    df: DataFrame,
    root: str,
    topic: str,
    hour: str | None = None,
    by_ticker: bool = False,
    packed: bool = False,
) -> bool:
    """Append a dataset under its hour; False (and no files) if it is empty.

    ``hour`` names the folder for all rows; without it each row carries its own
    ``dt_hour``. The rebalance gives each hour few, evenly sized files and splits
    an hour that outgrows one task. ``by_ticker`` adds a folder per ticker for
    readers that want one, at the price of many more files. Rows are counted while
    they are written, so the frame is computed once. ``packed`` compresses the files
    (gzip, a fifth of the plain size for bars); readers tell it by their names.
    """
    stamped, rows = counted(df.withColumn("dt_hour", F.lit(hour)) if hour else df)
    folders = ["dt_hour", "ticker"] if by_ticker else ["dt_hour"]
    # One folder for all rows needs even files only; a key would send them all to one task first.
    spread = folders if hour is None or by_ticker else []
    writer = stamped.hint("rebalance", *spread).write.mode("append").partitionBy(*folders).option("ignoreNullFields", "false")
    if packed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PACKED_ROWS)
    with shuffles_dropped(df.sparkSession):
        writer.json(topic_path(root, topic))
    return rows_written(rows) > 0
