"""Message topics to the raw lake."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.temporal import hour_bucket
from tickloom.sinks.commits import CommitLog
from tickloom.sources.lake import compacted_root
from tickloom.sources.streams import decode
from tickloom.specs import ARCHIVED_TOPICS

#: After the end of an hour, how long its last micro-batch may still be writing.
SETTLE_SECONDS = 3600

# Fixed value: the field that carries a message's arrival.
STAMP = "kafka_ingested_at"


def stamped_message(value: Column, now: Column) -> Column:
    """Append the ingest time to a JSON object; any other text only loses its line breaks.

    The field goes in before the closing brace, so unknown fields keep their
    order, types and spelling; readers take the last value of a repeated field.
    Line breaks become blanks, because a record is a line: one message gives one record.
    """
    line = F.regexp_replace(value, r"[\r\n]+", " ")
    is_object = F.ltrim(line).startswith("{") & F.try_parse_json(value).isNotNull()
    body = F.regexp_replace(line, r"\s*\}\s*$", "")
    comma = F.when(F.trim(body) == "{", F.lit("")).otherwise(F.lit(","))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(is_object, F.concat(body, comma, F.lit(f'"{STAMP}":"'), stamp, F.lit('"}'))).otherwise(line)


def archive_rows(messages: DataFrame) -> DataFrame:
    """(value, topic, dt_hour) of each message, stamped with its arrival."""
    now = F.current_timestamp()
    return decode(messages).select(
        stamped_message(F.col("value"), now).alias("value"), "topic", hour_bucket(now).alias("dt_hour")
    )


def start_archive_stream(
    messages: DataFrame, root: str, checkpoint: str, available_now: bool = False, trigger: str = "1 minute", topics: Sequence[str] = ARCHIVED_TOPICS
) -> StreamingQuery:
    """Copy the messages of ``topics`` to ``<root>/topic=<t>/dt_hour=<h>/``.

    One query serves every topic; files are committed exactly once through the
    checkpoint, a few per topic and trigger rather than one per message.
    """
    writer = (
        archive_rows(messages)
        .where(F.col("topic").isin(list(topics)))
        .writeStream.format("text")
        .partitionBy("topic", "dt_hour")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def archived_hours(spark: SparkSession, root: str, topic: str) -> list[str]:
    """The ingest hours that the archive has of a topic."""
    names = CommitLog(spark, root).children(f"topic={topic}", "dt_hour=")
    return sorted(n.split("=", 1)[1] for n in names)


def compact_archive(spark: SparkSession, root: str, topic: str, hour: str, settle_seconds: float = SETTLE_SECONDS) -> bool:
    """Merge the small files of one hour of a topic into few; False if that was done before.

    The merged files lie beside the archive and are committed to a log of their own; from then on ``scan_archive``
    takes that hour from them, and everything else from the archive. The stream's files and its log stay as they are, so readers that
    stream the archive see each message once as well. An hour that may still get messages is refused.
    """
    ended = dt.datetime.strptime(hour, "%Y-%m-%d_%H").replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=1)
    if dt.datetime.now(dt.timezone.utc) < ended + dt.timedelta(seconds=settle_seconds):
        raise ValueError(f"{hour} may still get messages")
    log, part = CommitLog(spark, compacted_root(root)), f"{topic}/{hour}"
    if part in log.latest().parts:
        return False
    folder = f"{part}/{uuid4().hex}"
    lines = spark.read.schema("value string, topic string, dt_hour string").text(root)
    lines = lines.where((F.col("topic") == topic) & (F.col("dt_hour") == hour)).select("value")
    lines.hint("rebalance").write.text(f"{log.path}/{folder}")
    # Of two that merge the same hour the first one's files count.
    settled = log.commit(lambda now: now if part in now.parts else replace(now, parts={**now.parts, part: folder}))
    if settled.parts[part] != folder:
        log.delete(folder)
    return settled.parts[part] == folder
