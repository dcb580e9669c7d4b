"""The registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import default_now, normalize_names
from tickloom.functions.temporal import flexible_date, hour_bucket
from tickloom.operators.bars import daily_bars, intraday_bars
from tickloom.operators.history import version_history
from tickloom.operators.incremental import backfill_range, high_water, lookback, newer_than
from tickloom.operators.indicators import moving_indicators
from tickloom.operators.joins import members_only, with_calendar, with_dimension
from tickloom.operators.latest import keyed_replace, one_per_key
from tickloom.operators.quality import batch_sizes, quality_counts, quality_report, rolled_up
from tickloom.plans.batch import normalize, normalize_loads, run_topic, typed_rows
from tickloom.plans.landing import land, prepare, relabel_index, ticker_rows, validate
from tickloom.plans.warehouse import (
    append_company_history,
    append_indicators,
    calendar,
    company_history,
    long_term_indicators,
    newer_indicators,
    publish_company_history,
    publish_indicators,
    short_term_indicators,
)
from tickloom.session import apply_session_conf
from tickloom.sinks.buckets import write_bucketed
from tickloom.sinks.lake import write_records
from tickloom.sinks.messages import encode
from tickloom.sinks.tables import PARTITION, append_load, compact, expire, read_current, read_loads
from tickloom.sources.drift import drift, field_types, scan_variant
from tickloom.sources.lake import read_json, scan_archive, scan_partitioned, scan_topic, split_corrupt
from tickloom.sources.streams import file_stream
from tickloom.specs import ARCHIVED_TOPICS, DATASETS, TABLES, TICK_TOPIC
from tickloom.streaming.archive import archived_hours, compact_archive, start_archive_stream
from tickloom.streaming.highwater import accepted_rows, start_incremental_stream
from tickloom.streaming.recent import start_deduplicated_stream, start_new_tick_stream
from tickloom.streaming.ticks import latest_ticks, parse_ticks, start_bar_stream, start_tick_stream, wait
from tickloom.suite import raw
from tickloom.workspace import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC times, the form SQL engines return."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(build: Query) -> Query:
    """Register ``build`` under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(apply_session_conf(spark), sf_dir.rstrip("/")))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    _REGISTRY[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- batch datasets ----------------------------------------------------------


@query
def daily_price_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily bars to one typed row per ticker and time."""
    return normalize(raw.bars_feed(spark, sf_dir), DATASETS["daily_price"])


@query
def daily_price_with_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill and daily feed of one table; the daily feed supersedes."""
    return normalize_loads(
        [
            (raw.backfill_feed(spark, sf_dir), DATASETS["daily_price_backfill"]),
            (raw.bars_feed(spark, sf_dir), DATASETS["daily_price"]),
        ]
    )


@query
def benchmark_index_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars under the stored index name; a single ticker holds all rows."""
    return normalize(relabel_index(raw.index_feed(spark, sf_dir)), DATASETS["benchmark_index"])


@query
def company_metadata_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest company profile per ticker."""
    return normalize(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"])


@query
def ticker_list_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker dimension."""
    return normalize(raw.ticker_feed(spark, sf_dir), DATASETS["ticker_list"])


@query
def financial_ratio_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios with cleaned column names; absent metrics stay absent."""
    return normalize(normalize_names(raw.ratio_feed(spark, sf_dir)), DATASETS["financial_ratio"])


def _five_minute_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = intraday_bars(raw.trades(spark, sf_dir), tie_break=("event_id",))
    values = [raw.text(c).alias(c) for c in ("time", "open", "high", "low", "close", "volume")]
    return bars.select("ticker", *values, F.lit("intraday_price").alias("type"))


@query
def intraday_price_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars through the same job as daily bars."""
    return normalize(_five_minute_feed(spark, sf_dir), DATASETS["intraday_price"])


@query
def typed_and_filled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim, typing and null fill before any key is compared."""
    return typed_rows(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"])


@query
def flexible_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many founding dates of each parsed day, unreadable ones as null."""
    founded = raw.company_feed(spark, sf_dir).select(flexible_date(F.col("founded_date")).alias("founded_date"))
    return founded.groupBy("founded_date").agg(F.count(F.lit(1)).alias("companies"))


# --- lake --------------------------------------------------------------------


@query
def json_lake_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as JSON lines and read back with an explicit schema."""
    root = shared_dir(spark, "lake")
    ticks = parse_ticks(raw.tick_messages(spark, sf_dir)).withColumn("time", raw.text("time"))
    write_records(ticks, root, TICK_TOPIC, hour="2024-02-01_00")
    schema = (
        "ticker string, time string, price string, volume bigint, "
        "match_type string, buy_vol bigint, sell_vol bigint"
    )
    scanned, _ = split_corrupt(scan_topic(spark, root, TICK_TOPIC, schema=schema))
    return scanned


@query
def hour_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per ingest hour, from a lake partitioned by hour."""
    root = shared_dir(spark, "hours")
    trades = raw.trades(spark, sf_dir).withColumn("dt_hour", hour_bucket(F.col("time")))
    write_records(trades.withColumn("time", F.col("time").cast("string")), root, "trades")
    schema = "ticker string, time string, price decimal(20,2), volume bigint, event_id bigint"
    return scan_partitioned(spark, root, "trades", schema).groupBy("dt_hour").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("price").cast("decimal(38,2)").alias("price_sum"),
        F.sum("volume").alias("volume"),
    )


@query
def lake_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of three ingest hours whose records differ, and what changed from each hour to the next."""
    root = shared_dir(spark, "drift")
    events = raw.table(spark, sf_dir, "events").withColumn("ticker", F.concat(F.lit("U"), raw.text("user_id")))
    k = F.get_json_object("props", "$.k").cast("bigint").alias("volume")
    shapes = (
        F.struct("ticker", "event_id", F.col("event_type").alias("extra")),
        F.struct("ticker", "event_id", k, F.col("user_id").alias("extra")),
        F.struct(raw.text("event_id").alias("event_id"), k, F.col("user_id").alias("extra")),
    )
    for hour, shape in enumerate(shapes):
        rows = events.where(F.col("event_id") % 3 == hour).select(F.to_json(shape).alias("value"))
        rows.write.text(f"{root}/topic=trades/dt_hour=2024-02-01_0{hour}")
    found = field_types(scan_variant(spark, root, "trades"))
    root = shared_dir(spark, "field-types")
    found.write.parquet(root)
    kept = spark.read.schema(found.schema).parquet(root)
    return kept.join(drift(kept), ["dt_hour", "field"], "full").select("dt_hour", "field", "type", "records", "change", "was")


@query
def validated_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, land as JSON, then run the batch job over what landed."""
    root, hour, spec = shared_dir(spark, "landing"), "2024-01-02_17", DATASETS["daily_price"]
    land(_typed_bars(spark, sf_dir), "daily_price", root, hour)
    landed, _ = split_corrupt(scan_topic(spark, root, "daily_price", hour, spec.raw_schema))
    return normalize(landed, spec)


# --- jobs, from raw files to published tables ----------------------------------


def _run_job(spark: SparkSession, topic: str, feed: DataFrame, lake: str, warehouse: str, load: int = 0) -> DataFrame:
    """Lay the feed down in two ingest hours with broken records between, run the job, read the table."""
    hours = ("2024-01-02_16", "2024-01-02_17")
    # The rows of a key land in one hour: between hours the later one would win.
    key = [c for c in DATASETS[topic].keys if c in feed.columns]
    hour = F.when(F.pmod(F.xxhash64(*key), F.lit(2)) == 0, hours[0]).otherwise(hours[1])
    write_records(feed.withColumn("dt_hour", hour), lake, topic, packed=True)
    broken = spark.range(3).select(F.concat(F.lit('{"ticker": "X'), F.col("id").cast("string"), F.lit('", ')).alias("value"))
    broken.write.mode("append").text(f"{lake}/topic={topic}/dt_hour={hours[0]}")
    result = run_topic(spark, topic, lake, warehouse, load, quarantine_root=f"{lake}/held")
    if result.corrupt_rows != 3 or not result.quarantined:
        raise AssertionError(f"{topic}: {result}")
    table = DATASETS[topic].table
    return read_current(spark, f"{warehouse}/{table}", TABLES[table])


def _job(spark: SparkSession, topic: str, feed: DataFrame) -> DataFrame:
    root = shared_dir(spark, "job")
    return _run_job(spark, topic, feed, f"{root}/lake", f"{root}/tables")


@query
def daily_price_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from raw files to the fact table."""
    return _job(spark, "daily_price", raw.bars_feed(spark, sf_dir))


@query
def daily_price_backfill_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backfill's load, then the daily load of the same table."""
    root = shared_dir(spark, "job")
    _run_job(spark, "daily_price_backfill", raw.backfill_feed(spark, sf_dir), f"{root}/lake", f"{root}/tables", 0)
    return _run_job(spark, "daily_price", raw.bars_feed(spark, sf_dir), f"{root}/lake", f"{root}/tables", 1)


@query
def benchmark_index_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars from raw files to the fact table."""
    return _job(spark, "benchmark_index", relabel_index(raw.index_feed(spark, sf_dir)))


@query
def company_metadata_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles from raw files to the dimension; columns the source lacks are null."""
    current = _job(spark, "company_metadata", raw.company_feed(spark, sf_dir))
    return current.select("ticker", "symbol", "exchange", "founded_date", "charter_capital", "listing_price", "as_of_date")


@query
def ticker_list_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers and groups from raw files to the dimension."""
    return _job(spark, "ticker_list", raw.ticker_feed(spark, sf_dir))


@query
def financial_ratio_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios under any spelling to the fact table; a metric no record carries stays null."""
    current = _job(spark, "financial_ratio", raw.ratio_feed(spark, sf_dir))
    return current.select("ticker", "year", "quarter", "pe", "pb", "ps", "ev_ebitda", "roe")


@query
def intraday_price_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars from raw files to the fact table."""
    return _job(spark, "intraday_price", _five_minute_feed(spark, sf_dir))


# --- keyed tables ------------------------------------------------------------


def _order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), raw.text("o_custkey")).alias("ticker"),
        raw.utc("o_orderdate").alias("created_at"),
        "o_orderkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(20,2)").alias("price"),
    )


@query
def keyed_replace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of one keyed table; the latest load of a key wins."""
    updates = _order_updates(spark, sf_dir)
    status = F.col("o_orderstatus")
    loads = [updates.where(status == "F"), updates.where(status == "O"), updates.where(~status.isin("F", "O"))]
    return keyed_replace(loads, ["ticker"], "load")


@query
def keyed_replace_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the newest explicit version column wins."""
    return one_per_key(_order_updates(spark, sf_dir), ["ticker"], ("created_at", "o_orderkey"))


@query
def versioned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a customer, numbered by age."""
    return version_history(_order_updates(spark, sf_dir), ["ticker"], "created_at", ["o_orderkey"])


# So many ranges that customers and tickers are cut even in the test tables.
_MANY_RANGES = 61


@query
def versioned_history_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every busy customer cut into several ranges."""
    return version_history(_order_updates(spark, sf_dir), ["ticker"], "created_at", ["o_orderkey"], _MANY_RANGES)


@query
def published_table_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads published as partitioned, sorted files; one row per key read."""
    path, spec = shared_dir(spark, "fact_daily_price"), TABLES["fact_daily_price"]
    feeds = (("daily_price_backfill", raw.backfill_feed), ("daily_price", raw.bars_feed))
    for load, (topic, feed) in enumerate(feeds):
        append_load(normalize(feed(spark, sf_dir), DATASETS[topic]), path, spec, load)
    return read_current(spark, path, spec)


@query
def published_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per month folder of a published table."""
    path, spec = shared_dir(spark, "fact_benchmark_index"), TABLES["fact_benchmark_index"]
    append_load(normalize(relabel_index(raw.index_feed(spark, sf_dir)), DATASETS["benchmark_index"]), path, spec, 0)
    return read_loads(spark, path, spec).groupBy(F.col(PARTITION).alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


# --- quality -----------------------------------------------------------------


def _typed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched frame: numbers typed, some closes missing, some lows negative."""
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    return raw.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), raw.text("l_suppkey"), F.lit("-"), (part % 40).cast("string")).alias("ticker"),
        F.when(part % 211 != 0, raw.text("l_shipdate")).alias("Time"),
        price.alias("open"),
        (price + F.col("l_quantity")).alias(" High"),
        F.when(part % 197 == 0, -price).otherwise(price - F.col("l_quantity")).alias("low"),
        F.when(part % 199 == 0, F.lit(float("nan"))).when(part % 193 != 0, price).alias("close"),
        F.col("l_quantity").alias("volume"),
    )


@query
def quality_report_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per ticker, check and column."""
    return quality_report(prepare(_typed_bars(spark, sf_dir), "daily_price"), "daily_price")


@query
def quality_report_mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with whole-number prices and no volume: every ticker is charged."""
    frame = prepare(_typed_bars(spark, sf_dir), "daily_price").withColumn("open", F.floor("open")).drop("volume")
    return quality_report(frame, "daily_price")


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tickers without any finding."""
    return validate(prepare(_typed_bars(spark, sf_dir), "daily_price"), "daily_price").accepted


@query
def quality_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per ticker held back, and the frame's width."""
    return batch_sizes(validate(prepare(_typed_bars(spark, sf_dir), "daily_price"), "daily_price").held_back)


@query
def quality_counts_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from counts that were kept for each hour, one of them counted twice and written again."""
    path, spec = shared_dir(spark, "quality_counts"), TABLES["quality_counts"]
    bars = prepare(_typed_bars(spark, sf_dir), "daily_price")
    part = F.pmod(F.xxhash64("ticker", "time", "open"), F.lit(3))
    for load, hour in enumerate((0, 1, 2, 1)):
        counts = quality_counts(bars.where(part == hour), "daily_price", F.lit(f"2024-01-02_1{hour}"))
        append_load(counts, path, spec, load)
    return rolled_up(read_current(spark, path, spec).where(F.col("check") != "rows"))


# --- membership and increments -------------------------------------------------


def _supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), raw.text("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").alias("time"),
        F.col("l_extendedprice").cast("decimal(20,2)").alias("price"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        "l_orderkey",
        "l_linenumber",
    )


@query
def group_member_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the tickers in one group."""
    groups = normalize(raw.ticker_feed(spark, sf_dir), DATASETS["ticker_list"])
    return members_only(_supplier_bars(spark, sf_dir), groups.where(F.col("group") == "G30"))


@query
def group_ticker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker rows built from a symbol list."""
    symbols = raw.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), raw.text("s_suppkey")).alias("symbol"))
    return ticker_rows(symbols, "VN30")


@query
def lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days up to a given day."""
    return lookback(_supplier_bars(spark, sf_dir), "time", "2001-06-15")


@query
def backfill_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the fixed history start to a given day (events lie in 2024)."""
    events = raw.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time"), "user_id", "value")
    return backfill_range(events, "time", "2024-01-20")


@query
def ticker_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest tick time per ticker."""
    return high_water(raw.trades(spark, sf_dir))


@query
def incremental_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full poll reduced to what is newer than the last poll's marks."""
    polled = raw.trades(spark, sf_dir)
    seen = polled.where(F.col("time") < F.lit("2024-01-15").cast("timestamp"))
    return newer_than(polled, high_water(seen))


@query
def kafka_payload_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as keyed JSON messages."""
    return encode(raw.trades(spark, sf_dir))


# --- streams -------------------------------------------------------------------


@query
def tick_parse_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to typed ticks, before duplicates are resolved."""
    return parse_ticks(raw.tick_messages(spark, sf_dir))


@query
def tick_batch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick table computed in one batch."""
    return latest_ticks(parse_ticks(raw.tick_messages(spark, sf_dir)))


@query
def tick_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick table computed by the stream in several micro-batches."""
    root = shared_dir(spark, "ticks")
    raw.tick_messages(spark, sf_dir).repartition(8).write.text(f"{root}/messages")
    messages = file_stream(spark, f"{root}/messages", files_per_batch=3)
    wait(start_tick_stream(messages, f"{root}/table", f"{root}/checkpoint", available_now=True))
    return read_current(spark, f"{root}/table", TABLES["fact_intraday_tick"])


_ARCHIVED = "event_id bigint, user_id bigint, value double, event_type string, kafka_ingested_at string"


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """All events archived under six topics; gives the archive's root."""
    root = shared_dir(spark, "archive")
    events = raw.table(spark, sf_dir, "events")
    by_type = F.create_map(*[F.lit(x) for pair in _TOPIC_OF_EVENT.items() for x in pair])
    # Half of the largest kind stands in for the sixth topic.
    topic = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "ticker_list").otherwise(by_type[F.col("event_type")])
    messages = events.select(F.to_json(F.struct("event_id", "user_id", "value", "event_type")).alias("value"), topic.alias("topic"))
    messages.hint("rebalance", "topic").write.partitionBy("topic").text(f"{root}/messages")
    source = file_stream(spark, f"{root}/messages")
    wait(start_archive_stream(source, f"{root}/lake", f"{root}/checkpoint", available_now=True))
    return f"{root}/lake"


@query
def raw_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of several topics archived by one stream and read back."""
    archived = read_json(spark, _archive(spark, sf_dir), f"{_ARCHIVED}, topic string, dt_hour string")
    is_stamped = F.col("kafka_ingested_at").isNotNull().alias("is_stamped")
    return archived.select("event_id", "user_id", "value", "event_type", "topic", is_stamped)


@query
def raw_archive_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archive by topic, half of the topics with their hours merged into few files."""
    root = _archive(spark, sf_dir)
    for topic in ARCHIVED_TOPICS[::2]:
        for hour in archived_hours(spark, root, topic):
            compact_archive(spark, root, topic, hour, settle_seconds=-7200)
    stamped = F.col("kafka_ingested_at").isNotNull().alias("is_stamped")
    scans = [split_corrupt(scan_archive(spark, root, t, schema=_ARCHIVED))[0].withColumn("topic", F.lit(t)) for t in ARCHIVED_TOPICS]
    return reduce(DataFrame.unionByName, scans).select("event_id", "user_id", "value", "event_type", "topic", stamped)


# Which archived topic stands in for each kind of event.
_TOPIC_OF_EVENT = {
    "click": "benchmark_index",
    "error": "company_metadata",
    "purchase": "daily_price",
    "signup": "daily_price_backfill",
    "view": "intraday_price",
}


@query
def incremental_tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three growing polls through the incremental stream; no tick is sent twice."""
    root = shared_dir(spark, "polls")
    schema = "ticker string, time timestamp, price decimal(20,2), volume bigint, event_id bigint"
    polled = raw.trades(spark, sf_dir)
    for poll, until in enumerate(("2024-01-11", "2024-01-21", None)):
        part = polled.where(F.col("time") < F.lit(until).cast("timestamp")) if until else polled
        part.write.parquet(f"{root}/polls/{poll}")
        source = spark.readStream.schema(schema).parquet(f"{root}/polls/*")
        wait(start_incremental_stream(source, f"{root}/sent", f"{root}/checkpoint"))
    return accepted_rows(spark, f"{root}/sent", schema)


_TRADE_SCHEMA = "ticker string, time timestamp, price decimal(20,2), volume bigint, event_id bigint"


@query
def tick_stream_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three growing polls, the last two waiting together, through state per ticker: each tick once, with the run that sent it."""
    root = shared_dir(spark, "state")
    polled = raw.trades(spark, sf_dir)
    for run, untils in enumerate((("2024-01-11",), ("2024-01-21", None))):
        for poll, until in enumerate(untils):
            part = polled.where(F.col("time") < F.lit(until).cast("timestamp")) if until else polled
            part.write.parquet(f"{root}/polls/{run}-{poll}")
        source = spark.readStream.schema(_TRADE_SCHEMA).parquet(f"{root}/polls/*")
        wait(start_new_tick_stream(source, f"{root}/sent", f"{root}/checkpoint"))
    return spark.read.schema(_TRADE_SCHEMA).parquet(f"{root}/sent")


@query
def tick_stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks sent twice, and once more long after: each (ticker, time) once, the late ones beside them."""
    root = shared_dir(spark, "late")
    ticks = parse_ticks(raw.tick_messages(spark, sf_dir)).select("ticker", "time").distinct()
    cut = F.lit("2024-01-16").cast("timestamp")
    # The first part twice, the second part with repeats of the last hours, then the first part again.
    parts = (
        ticks.where(F.col("time") < cut).withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("_again"),
        ticks.where(F.col("time") >= cut),
        ticks.where(F.col("time") < cut),
    )
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("ticker string, time timestamp").parquet(f"{root}/in")
        wait(start_deduplicated_stream(source, f"{root}/out", f"{root}/checkpoint", delay_seconds=86_400))
    return spark.read.schema("ticker string, time timestamp, is_late boolean").parquet(f"{root}/out")


@query
def tick_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars that the stream closes, over three runs; a last tick beyond all others closes the rest."""
    root = shared_dir(spark, "bars")
    trades = raw.trades(spark, sf_dir)
    last = trades.agg(F.max("time").alias("time")).select(
        F.lit("END").alias("ticker"), (F.col("time") + F.expr("interval 1 day")).alias("time"),
        F.lit(0).cast("decimal(20,2)").alias("price"), F.lit(0).cast("bigint").alias("volume"), F.lit(0).cast("bigint").alias("event_id"),
    )
    bounds = [F.lit(t).cast("timestamp") for t in ("2024-01-11", "2024-01-21")]
    time = F.col("time")
    for part in (trades.where(time < bounds[0]), trades.where((time >= bounds[0]) & (time < bounds[1])), trades.where(time >= bounds[1]).unionByName(last)):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(_TRADE_SCHEMA).parquet(f"{root}/in")
        wait(start_bar_stream(source, f"{root}/out", f"{root}/checkpoint", tie_break=("event_id",)))
    schema = "ticker string, open decimal(20,2), high decimal(20,2), low decimal(20,2), close decimal(20,2), volume bigint, time timestamp"
    return spark.read.schema(schema).parquet(f"{root}/out")


# --- derived tables --------------------------------------------------------------


@query
def dim_date_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar over the order dates."""
    return calendar(raw.table(spark, sf_dir, "orders"), "o_orderdate")


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_updates(spark, sf_dir).select(
        "ticker", F.to_date("created_at").alias("date_id"), "price", F.lit(1).cast("bigint").alias("trades")
    )


@query
def star_join_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by calendar month and the exchange of the company."""
    facts = _order_facts(spark, sf_dir)
    companies = normalize(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"]).select("ticker", "exchange")
    joined = with_dimension(with_calendar(facts, calendar(facts)), companies)
    return joined.groupBy("year", "month", "exchange").agg(
        F.sum("price").cast("decimal(38,2)").alias("turnover"), F.sum("trades").alias("trades")
    )


@query
def star_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tables in the same buckets of the ticker: facts and companies meet without a shuffle."""
    root = shared_dir(spark, "buckets")
    facts = write_bucketed(_order_facts(spark, sf_dir), f"{root}/facts", buckets=8)
    companies = normalize(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"]).select("ticker", "exchange")
    companies = write_bucketed(companies, f"{root}/companies", buckets=8)
    joined = with_calendar(with_dimension(facts, companies, bucketed=True), calendar(facts))
    return joined.groupBy("year", "month", "exchange").agg(
        F.sum("price").cast("decimal(38,2)").alias("turnover"), F.sum("trades").alias("trades")
    )


@query
def star_join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by ticker group and weekday; tickers without a group kept."""
    facts = daily_bars(_supplier_bars(spark, sf_dir), tie_break=("l_orderkey", "l_linenumber", "price", "volume"))
    groups = normalize(raw.ticker_feed(spark, sf_dir), DATASETS["ticker_list"])
    joined = with_dimension(with_calendar(facts, calendar(facts)), groups)
    return joined.groupBy("group", "day_of_week", "is_weekend").agg(
        F.count(F.lit(1)).alias("bars"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
    )


@query
def ohlcv_bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of the trades."""
    return intraday_bars(raw.trades(spark, sf_dir), tie_break=("event_id",))


@query
def ohlcv_bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier."""
    return daily_bars(_supplier_bars(spark, sf_dir), tie_break=("l_orderkey", "l_linenumber", "price", "volume"))


def _daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(_supplier_bars(spark, sf_dir), tie_break=("l_orderkey", "l_linenumber", "price", "volume"))
    return bars.select("ticker", F.col("date_id").cast("timestamp").alias("time"), "date_id", "close")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def indicators_long_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI(14) and SMA(200) per ticker and day."""
    return _rounded(long_term_indicators(_daily_closes(spark, sf_dir)), "rsi_14", "sma_200")


@query
def indicators_short_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI(3) and SMA(10) per ticker and day."""
    return _rounded(short_term_indicators(_daily_closes(spark, sf_dir)), "rsi_3", "sma_10")


@query
def indicators_of_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI(3) and SMA(10) over single trades, which a ticker may have any number of."""
    closes = raw.trades(spark, sf_dir).select("ticker", "time", F.col("price").alias("close"))
    return _rounded(moving_indicators(one_per_key(closes, ["ticker", "time"]), (10,), (3,)), "rsi_3", "sma_10")


@query
def indicators_of_trades_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tickers cut into ranges and short blocks."""
    closes = raw.trades(spark, sf_dir).select("ticker", "time", F.col("price").alias("close"))
    moved = moving_indicators(one_per_key(closes, ["ticker", "time"]), (10,), (3,), block_rows=64, ranges=_MANY_RANGES)
    return _rounded(moved, "rsi_3", "sma_10")


@query
def company_history_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company snapshots with version, validity interval and current flag."""
    snapshots = typed_rows(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"]).select(
        "ticker", "as_of_date", "charter_capital", "exchange"
    )
    return company_history(snapshots)


def _repeated_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company snapshot twice a day, the second with another capital."""
    snapshots = typed_rows(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"]).select(
        "ticker", "as_of_date", "charter_capital", "exchange"
    )
    return snapshots.unionByName(snapshots.withColumn("charter_capital", (F.col("charter_capital") + 1).cast("decimal(20,2)")))


@query
def company_history_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a company on one day, companies cut into ranges: one reproducible version."""
    return company_history(_repeated_snapshots(spark, sf_dir), _MANY_RANGES)


@query
def company_history_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history written as a table and read back."""
    root = shared_dir(spark, "history")
    publish_company_history(_repeated_snapshots(spark, sf_dir), root, 0)
    current = read_current(spark, f"{root}/dim_company_history", TABLES["dim_company_history"])
    return current.select("ticker", "valid_from", "valid_to", "version", "is_current", "charter_capital", "exchange")


@query
def incremental_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three polls, all waiting when the stream starts: the same ticks, each once."""
    root = shared_dir(spark, "backlog")
    schema = "ticker string, time timestamp, price decimal(20,2), volume bigint, event_id bigint, poll int"
    polled = raw.trades(spark, sf_dir)
    for poll, until in enumerate(("2024-01-11", "2024-01-21", None)):
        part = polled.where(F.col("time") < F.lit(until).cast("timestamp")) if until else polled
        part.withColumn("poll", F.lit(poll)).write.parquet(f"{root}/polls/{poll}")
    source = spark.readStream.schema(schema).parquet(f"{root}/polls/*")
    wait(start_incremental_stream(source, f"{root}/sent", f"{root}/checkpoint", poll="poll"))
    return accepted_rows(spark, f"{root}/sent", schema.removesuffix(", poll int")).drop("batch_id")


@query
def compacted_plus_later_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill and daily loads compacted, then a load that corrects a third of the tickers."""
    path, spec = shared_dir(spark, "fact_daily_price"), TABLES["fact_daily_price"]
    feeds = (("daily_price_backfill", raw.backfill_feed), ("daily_price", raw.bars_feed))
    for load, (topic, feed) in enumerate(feeds):
        append_load(normalize(feed(spark, sf_dir), DATASETS[topic]), path, spec, load)
    compact(spark, path, spec)
    fixed = normalize(raw.bars_feed(spark, sf_dir), DATASETS["daily_price"]).where(F.substring("ticker", 2, 9).cast("int") % 3 == 0)
    append_load(fixed.withColumn("volume", F.col("volume") + 1), path, spec, 2)
    expire(spark, path)
    return read_current(spark, path, spec)


@query
def compacted_then_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads 0 and 2 compacted and expired; then load 1 arrives late and load 2 is written again with other volumes."""
    path, spec = shared_dir(spark, "fact_daily_price"), TABLES["fact_daily_price"]
    oldest = normalize(raw.backfill_feed(spark, sf_dir), DATASETS["daily_price_backfill"])
    newest = normalize(raw.bars_feed(spark, sf_dir), DATASETS["daily_price"])
    number = F.substring("ticker", 2, 9).cast("int")
    append_load(oldest, path, spec, 0)
    append_load(newest, path, spec, 2)
    compact(spark, path, spec)
    expire(spark, path)
    append_load(oldest.where(number % 5 == 0).withColumn("volume", F.col("volume") + 10), path, spec, 1)
    append_load(newest.withColumn("volume", F.col("volume") + 1), path, spec, 2)
    compact(spark, path, spec, upto=1)
    return read_current(spark, path, spec)


@query
def later_hour_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fetches of the same bars, the later one lower: it is what the table shows."""
    root, topic = shared_dir(spark, "hours"), "daily_price"
    bars = raw.bars_feed(spark, sf_dir).where("time IS NOT NULL")
    write_records(bars.withColumn("open", F.col("open") + 1000), f"{root}/lake", topic, "2024-01-02_17", packed=True)
    write_records(bars, f"{root}/lake", topic, "2024-01-03_17", packed=True)
    run_topic(spark, topic, f"{root}/lake", f"{root}/tables", 0)
    current = read_current(spark, f"{root}/tables/fact_daily_price", TABLES["fact_daily_price"])
    return current.select("ticker", "time", "open")


@query
def published_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the jobs report as written, against the tables."""
    root = shared_dir(spark, "counts")
    feeds = {"ticker_list": raw.ticker_feed, "company_metadata": raw.company_feed, "daily_price": raw.bars_feed}
    reported = []
    for topic, feed in feeds.items():
        write_records(feed(spark, sf_dir), f"{root}/lake", topic, "2024-01-02_17")
        reported.append((topic, run_topic(spark, topic, f"{root}/lake", f"{root}/tables", 0).rows))
    return spark.createDataFrame(reported, "topic string, reported bigint")


@query
def ingest_time_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of which some lack an ingest time: the load time stands in for it."""
    known = F.when(F.col("event_id") % 3 != 0, F.col("time"))
    stamped = default_now(raw.trades(spark, sf_dir).withColumn("ingested_at", known))
    return stamped.select("event_id", "ingested_at", (F.col("ingested_at") != F.col("time")).alias("filled")).select(
        "event_id", F.when(~F.col("filled"), F.col("ingested_at")).alias("ingested_at"), "filled"
    )


@query
def indicators_short_term_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily indicators of the history, then those of later days from the rows they need alone."""
    closes = _daily_closes(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp")
    history = short_term_indicators(closes.where(F.col("time") < cut))
    return _rounded(history.unionByName(newer_indicators(closes, cut)), "rsi_3", "sma_10")


def _appended(spark: SparkSession, sf_dir: str, table: str, long_term: bool) -> DataFrame:
    """Indicators of the history, then five appends of later days, each from the tail and its own days alone."""
    root, closes = shared_dir(spark, "appended"), _daily_closes(spark, sf_dir)
    bounds = [F.lit(d).cast("timestamp") for d in ("1998-11-25", "1998-11-26", "1998-11-27", "1998-11-28", "1998-11-29")]
    time = F.col("time")
    publish_indicators(closes.where(time < bounds[0]), root, 0, long_term)
    for load, (first, stop) in enumerate(zip(bounds, [*bounds[1:], None]), 1):
        append_indicators(closes.where(time >= first if stop is None else (time >= first) & (time < stop)), root, load, long_term)
    return read_current(spark, f"{root}/{table}", TABLES[table]).drop("calculated_at")


@query
def indicators_short_term_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI(3) and SMA(10), published by a first load and five appends."""
    return _rounded(_appended(spark, sf_dir, "technical_indicators_daily", False), "rsi_3", "sma_10")


@query
def indicators_long_term_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSI(14) and SMA(200), published by a first load and five appends."""
    return _rounded(_appended(spark, sf_dir, "technical_indicators_historical", True), "rsi_14", "sma_200")


@query
def company_history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history from three loads of snapshots: the last of all arrives second, so some companies are numbered anew."""
    root = shared_dir(spark, "history")
    snapshots = _repeated_snapshots(spark, sf_dir)
    day = F.col("as_of_date")
    dates = [F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-02-10", "2024-03-21")]
    publish_company_history(snapshots.where(day == dates[0]), root, 0)
    append_company_history(snapshots.where((day == dates[2]) | (day == dates[1]) & (F.crc32(F.col("ticker").cast("binary")) % 2 == 0)), root, 1)
    append_company_history(snapshots.where(day == dates[1]), root, 2)
    current = read_current(spark, f"{root}/dim_company_history", TABLES["dim_company_history"])
    return current.select("ticker", "valid_from", "valid_to", "version", "is_current", "charter_capital", "exchange")


@query
def published_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles written again with the same date: the later load wins, whatever it says."""
    root, spec = shared_dir(spark, "corrections"), TABLES["dim_company"]
    first = normalize(raw.company_feed(spark, sf_dir), DATASETS["company_metadata"])
    append_load(first, root, spec, 0)
    append_load(first.withColumn("charter_capital", (F.col("charter_capital") - 1).cast("decimal(20,2)")), root, spec, 1)
    return read_current(spark, root, spec).select("ticker", "as_of_date", "charter_capital", "exchange")
