"""Trade ticks: message stream to keyed tick table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.counting import counted, rows_written
from tickloom.functions.casts import MONEY, retype
from tickloom.functions.columns import FILL_TEXT, FILL_WHOLE, default_now
from tickloom.operators.bars import stream_bars
from tickloom.operators.latest import one_per_key
from tickloom.sinks.tables import append_load
from tickloom.sources.streams import decode
from tickloom.specs import TABLES, TICK_SCHEMA

logger = logging.getLogger(__name__)

# Fixed value: the time between two micro-batches.
TRIGGER = "15 seconds"
TICK_TABLE = TABLES["fact_intraday_tick"]


def parse_ticks(messages: DataFrame) -> DataFrame:
    """Messages to typed ticks; batch and stream run this same function.

    Messages without ticker or time, with an unreadable time, or that are no JSON
    object are dropped. Volumes and match type are filled, price and ingest time
    stay null if unknown. Exploding the one-element array keeps the filters above
    the parser, so each message is parsed once.
    """
    parsed = decode(messages).select(F.inline(F.array(F.from_json("value", TICK_SCHEMA))))
    keyed = parsed.where(F.col("ticker").isNotNull() & F.col("time").isNotNull())
    typed = retype(
        keyed,
        {
            "time": "timestamp",
            "price": MONEY,
            "volume": "bigint",
            "buy_vol": "bigint",
            "sell_vol": "bigint",
            "ingested_at": "timestamp",
        },
    )
    filled = typed.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(FILL_WHOLE)) for c in ("volume", "buy_vol", "sell_vol")},
            "match_type": F.coalesce(F.col("match_type"), F.lit(FILL_TEXT)),
        }
    )
    return filled.where(F.col("time").isNotNull())


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """One tick per (ticker, time), the most recently ingested one."""
    return one_per_key(ticks, TICK_TABLE.keys, TICK_TABLE.version)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Publish one micro-batch; a replayed batch replaces its first attempt."""
    if batch.isEmpty():
        return
    ticks, counter = counted(default_now(latest_ticks(batch)))
    append_load(ticks, path, TICK_TABLE, batch_id)
    logger.info("batch %d: %d ticks", batch_id, rows_written(counter))


def start_tick_stream(
    messages: DataFrame, path: str, checkpoint: str, available_now: bool = False, trigger: str = TRIGGER
) -> StreamingQuery:
    """Run the tick job; duplicates across batches are resolved on read."""
    writer = (
        parse_ticks(messages)
        .writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def start_bar_stream(ticks: DataFrame, path: str, checkpoint: str, width: str = "5 minutes", delay: str = "10 minutes", tie_break: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Write the bars of a stream of ticks as they close."""
    bars = stream_bars(ticks, width, delay, tie_break=tie_break)
    writer = bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def wait(query: StreamingQuery) -> None:
    """Block until the query ends; a failure is raised here."""
    query.awaitTermination()


def without_repeats(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a (ticker, time) inside the stream itself.

    State is bounded by the watermark. The first arrival wins, so this suits
    feeds that resend identical ticks.
    """
    return ticks.withWatermark("time", delay).dropDuplicatesWithinWatermark(list(TICK_TABLE.keys))
