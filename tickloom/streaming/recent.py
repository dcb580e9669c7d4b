"""What a stream has shown lately, as state per ticker.

The state of a ticker is its latest time and the keys it has shown within ``delay`` of that. It lives in the stream's own
state store: nothing is written beside the stream, a restart goes on from the checkpoint, and how rows
are grouped into micro-batches does not change the result as long as no row is more than ``delay`` late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.casts import quoted
from tickloom.workspace import let_workers_import

DELAY_SECONDS = 600
#: A ticker that shows nothing for so long is forgotten, with its state.
SILENT_SECONDS = 7 * 24 * 3600

_STATE = "latest long, times binary, keys binary"


def _split_state(state: GroupState) -> tuple[int | None, np.ndarray, np.ndarray]:
    if not state.exists:
        return None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    latest, times, keys = state.get
    return latest, np.frombuffer(times, np.int64), np.frombuffer(keys, np.int64)


def first_seen(
    ticks: DataFrame, key: Sequence[str] = (), delay_seconds: int = DELAY_SECONDS, silent_seconds: int = SILENT_SECONDS, keep_late: bool = False,
    time_col: str = "time", ticker: str = "ticker",
) -> DataFrame:
    """The first row of each (ticker, ``key``) of a stream; ``key`` is the whole row where none is given.

    A row at least ``delay_seconds`` older than the latest that its ticker had shown before the micro-batch is late: nobody
    remembers whether it was there. Such rows are left out, or kept with ``is_late`` true under ``keep_late``,
    for a table of their own. Of rows of one key in one micro-batch any may be the first. Rows without ticker or time never pass.
    """
    let_workers_import(ticks.sparkSession)
    columns = ticks.columns
    delay = delay_seconds * 1_000_000
    rows = ticks.where(quoted(ticker).isNotNull() & quoted(time_col).isNotNull())
    # Silence is measured by arrival. A timeout by the clock would keep a run over what is available from ever ending.
    rows = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds").withColumn("_millis", F.unix_millis("_arrived"))
    rows = rows.withColumn("_at", F.unix_micros(quoted(time_col))).withColumn("_key", F.xxhash64(*[quoted(c) for c in (time_col, *(key or columns))]))
    out = T.StructType([*ticks.schema.fields, *([T.StructField("is_late", T.BooleanType())] if keep_late else [])])

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, times, keys = _split_state(state)
        latest, arrived = before, 0
        for frame in frames:
            if not len(frame):
                continue
            arrived = int(frame["_millis"].max())
            late = np.zeros(len(frame), bool) if before is None else (frame["_at"] <= before - delay).to_numpy()
            new = ~late & ~frame["_key"].isin(keys).to_numpy() & ~frame["_key"].duplicated().to_numpy()
            fresh = frame[new]
            times, keys = np.append(times, fresh["_at"].to_numpy(np.int64)), np.append(keys, fresh["_key"].to_numpy(np.int64))
            if len(fresh):
                latest = int(fresh["_at"].max()) if latest is None else max(latest, int(fresh["_at"].max()))
            shown = frame[new | late] if keep_late else fresh
            if len(shown):
                yield shown[columns].assign(is_late=late[new | late]) if keep_late else shown[columns]
        if latest is not None:
            recent = times > latest - delay
            state.update((latest, times[recent].tobytes(), keys[recent].tobytes()))
            state.setTimeoutTimestamp(arrived + silent_seconds * 1000)

    shown = rows.groupBy(quoted(ticker)).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    # The filter lets all rows pass; behind it they are in the row format that a partitioned sink sorts.
    return shown.where(quoted(ticker).isNotNull())


def start_new_tick_stream(ticks: DataFrame, path: str, checkpoint: str, delay_seconds: int = DELAY_SECONDS, **trigger) -> StreamingQuery:
    """Write every tick of overlapping polls once, however the polls are grouped."""
    return _start(first_seen(ticks, delay_seconds=delay_seconds).writeStream.format("parquet").option("path", path), checkpoint, trigger)


def start_deduplicated_stream(
    ticks: DataFrame, path: str, checkpoint: str, delay_seconds: int = DELAY_SECONDS, key: Sequence[str] = ("time",), **trigger
) -> StreamingQuery:
    """Write the first tick of each (ticker, time) to ``<path>/is_late=false`` and every late one to ``<path>/is_late=true``."""
    rows = first_seen(ticks, key, delay_seconds, keep_late=True)
    return _start(rows.writeStream.format("parquet").partitionBy("is_late").option("path", path), checkpoint, trigger)


def _start(writer, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
