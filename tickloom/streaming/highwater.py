"""Incremental ticks: keep what is newer than the last tick seen per ticker.

The marks are a small table (one row per ticker), rewritten each batch under the
batch's own folder. A batch reads only marks of earlier batches, so a replay
makes the same decision as the first attempt.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.counting import counted, rows_written
from tickloom.operators.incremental import advance_marks, first_of_polls, newer_than
from tickloom.sinks.messages import encode

logger = logging.getLogger(__name__)

_MARKS = "ticker string, last_time timestamp"


def _marks_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], _MARKS)
    return spark.read.schema(_MARKS).parquet(f"{path}/batch_id={batch_id - 1}")


def accept_batch(
    batch: DataFrame,
    batch_id: int,
    rows_path: str,
    marks_path: str,
    send: Callable[[DataFrame], None] | None = None,
    poll: str | None = None,
) -> None:
    """Write the batch's new rows and the marks that hold after it.

    A batch may hold any number of overlapping polls, and a tick still counts once. ``poll`` names a column that numbers
    the polls; it is not kept. With it, equal rows of one poll all count; without it they are one tick.

    ``send`` receives the new rows as keyed messages. It is called before the
    marks are written, so a failure repeats messages rather than losing them.
    """
    spark = batch.sparkSession
    marks = _marks_before(spark, marks_path, batch_id)
    target = f"{rows_path}/batch_id={batch_id}"
    fresh = newer_than(batch, marks)
    # Without the number of the poll, a tick that several polls of the batch hold is known by being the same row.
    fresh = first_of_polls(fresh, poll).drop(poll) if poll is not None else fresh.dropDuplicates()
    fresh, counter = counted(fresh)
    fresh.write.mode("overwrite").parquet(target)
    accepted = spark.read.schema(fresh.schema).parquet(target)
    if send is not None:
        send(encode(accepted))
    advance_marks(marks, accepted).write.mode("overwrite").parquet(f"{marks_path}/batch_id={batch_id}")
    logger.info("batch %d: sent %d ticks", batch_id, rows_written(counter))


def start_incremental_stream(
    ticks: DataFrame,
    root: str,
    checkpoint: str,
    send: Callable[[DataFrame], None] | None = None,
    poll: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Accept typed ticks into ``<root>/rows``; marks are kept in ``<root>/marks``.

    Name the ``poll`` column where equal rows of one poll are different ticks. With ``send`` (for instance ``lambda m: publish(...)``) they are also sent on.
    """
    base = root.rstrip("/")
    return (
        ticks.writeStream.foreachBatch(
            lambda batch, batch_id: accept_batch(batch, batch_id, f"{base}/rows", f"{base}/marks", send, poll)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def accepted_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every accepted row with the ``batch_id`` that accepted it."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{root.rstrip('/')}/rows")
