"""Raw market feeds derived from the test tables.

None of the test tables is market data, so each feed is a projection of a whole
table with the blemishes real feeds have (padding, nulls, unreadable values),
placed by row keys so that SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("ticker", "time", "open", "high", "low", "close", "volume", "type")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str) -> Column:
    """Zone-less file times as instants (sessions run in UTC)."""
    return F.col(column).cast("timestamp")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def bars_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of padded tickers, some without a time or a volume."""
    price, spread = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("  S"), text("l_suppkey"), F.lit(" ")).alias("ticker"),
        F.when(F.col("l_partkey") % 97 != 0, text("l_shipdate")).alias("time"),
        price.alias("open"),
        (price + spread).alias("high"),
        (price - spread).alias("low"),
        price.alias("close"),
        F.when(F.col("l_linenumber") != 7, text("l_quantity")).alias("volume"),
        F.lit("daily_price").alias("type"),
    )


def backfill_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history as an older, coarser load: every price is the day's low."""
    low = F.col("l_extendedprice") - F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), text("l_suppkey")).alias("ticker"),
        text("l_shipdate").alias("time"),
        *[low.alias(c) for c in ("open", "high", "low", "close")],
        text("l_quantity").alias("volume"),
        F.lit("daily_price_backfill").alias("type"),
    )


def index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a single index symbol: one ticker holds every row."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.lit("VN30").alias("ticker"),
        text("o_orderdate").alias("time"),
        price.alias("open"),
        (price + 1).alias("high"),
        (price - 1).alias("low"),
        price.alias("close"),
        F.col("o_custkey").alias("volume"),
        F.lit("benchmark_index").alias("type"),
    )


def company_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three dated snapshots per company, dates spelt in four ways."""
    key = F.col("c_custkey")
    snapshots = table(spark, sf_dir, "customer").withColumn(
        "_snapshot", F.explode(F.sequence(F.lit(0), (key % 3).cast("int")))
    )
    founded = F.date_add(F.lit("1990-01-01").cast("date"), (key % 9000).cast("int"))
    listed = F.date_add(F.lit("2001-01-01").cast("date"), (key % 7000).cast("int"))
    return snapshots.select(
        F.concat(F.lit(" C"), key.cast("string")).alias("ticker"),
        F.concat(F.col("c_name"), F.lit("  ")).alias("symbol"),
        F.col("c_mktsegment").alias("exchange"),
        F.when(F.col("c_nationkey") > 4, F.concat(F.lit("nation "), text("c_nationkey"))).alias("address"),
        F.when(key % 4 == 0, F.date_format(founded, "dd/MM/yyyy"))
        .when(key % 4 == 1, F.date_format(founded, "yyyy-MM-dd"))
        .when(key % 4 == 2, F.lit("junk"))
        .alias("founded_date"),
        F.concat(F.date_format(listed, "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("listing_date"),
        (F.col("c_acctbal") + F.col("_snapshot")).alias("charter_capital"),
        F.concat(key.cast("string"), F.lit(".0")).alias("number_of_employees"),
        F.lit("10000").alias("par_value"),
        F.when(key % 5 != 0, key * 10).alias("listing_price"),
        F.concat(key.cast("string"), F.lit("00")).alias("listed_volume"),
        (F.col("c_acctbal") / 128).alias("free_float_percentage"),
        F.when(key % 7 == 0, F.lit("n/a")).otherwise(text("c_acctbal")).alias("free_float"),
        F.concat(key.cast("string"), F.lit(".9")).alias("outstanding_shares"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("_snapshot") * 40).cast("string").alias("as_of_date"),
        F.lit("company_metadata").alias("type"),
    )


def ticker_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded tickers with the group their nation belongs to."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("  S"), text("s_suppkey")).alias("ticker"),
            F.when(F.col("n_nationkey") < 8, F.lit("G30")).otherwise(F.lit("OTHER")).alias("group"),
            F.lit("ticker_list").alias("type"),
        )
    )


def ratio_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios under the spellings a source may use; most metrics are absent."""
    key = F.col("p_partkey")
    quarter = F.when(key % 5 == 4, F.lit("Yearly")).otherwise(F.concat(F.lit("Q"), (key % 5 + 1).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), (F.floor(key / 20)).cast("string")).alias("ticker"),
        (F.lit(2015) + F.col("p_size") % 5).cast("string").alias("year"),
        quarter.alias("quarter"),
        (F.col("p_retailprice") / 8).alias("PE"),
        F.when(F.col("p_size") > 3, F.col("p_retailprice") / 512).alias("pb"),
        F.col("p_size").cast("double").alias("EV EBITDA"),
        (F.col("p_size") / 128).alias(" roe "),
        F.lit("financial_ratio").alias("type"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean trades: (ticker, time, price, volume, event_id)."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), text("user_id")).alias("ticker"),
        utc("ts").alias("time"),
        F.col("value").cast("decimal(20,2)").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
        "event_id",
    )


def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick messages as JSON text, with missing and unreadable fields.

    Times are cut to the hour so that many ticks share a (ticker, time).
    """
    key = F.col("event_id")
    volume = F.get_json_object("props", "$.k")
    record = F.struct(
        F.when(key % 101 != 0, F.concat(F.lit("U"), text("user_id"))).alias("ticker"),
        F.when(key % 103 == 0, F.lit("bad"))
        .otherwise(F.date_trunc("hour", utc("ts")).cast("string"))
        .alias("time"),
        F.when(key % 107 == 0, F.lit("n/a")).otherwise(text("value")).alias("price"),
        F.concat(volume, F.lit(".0")).alias("volume"),
        F.when(key % 109 != 0, F.when(F.col("event_type") == "signup", F.lit("ATO"))
               .when(F.col("event_type") == "error", F.lit("ATC")).otherwise(F.lit("LO"))).alias("match_type"),
        volume.alias("buy_vol"),
        F.when(key % 113 == 0, F.lit("abc")).otherwise((key % 1000).cast("string")).alias("sell_vol"),
        text("ts").alias("ingested_at"),
    )
    return table(spark, sf_dir, "events").select(F.to_json(record).alias("value"))
