"""The same queries as plain SQL over the same tables.

The texts are written from the meaning of each query, not from its Spark plan:
the raw feeds' blemishes are folded into the clean values they must become.
"""

from __future__ import annotations


def _money(expression: str, scale: int = 2) -> str:
    # Through text, so that rounding works on the shortest decimal form.
    return f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(20,{scale}))"


_DAILY = f"""
daily AS (
  SELECT 'S' || l_suppkey AS ticker,
         CASE WHEN l_partkey % 97 <> 0 THEN l_shipdate ELSE TIMESTAMP '1970-01-01 00:00:00' END AS time,
         {_money('l_extendedprice')} AS open,
         {_money('l_extendedprice + l_quantity')} AS high,
         {_money('l_extendedprice - l_quantity')} AS low,
         {_money('l_extendedprice')} AS close,
         CASE WHEN l_linenumber <> 7 THEN CAST(trunc(l_quantity) AS BIGINT) ELSE 0 END AS volume,
         1 AS load
  FROM lineitem)"""

_BACKFILL = f"""
backfill AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate AS time,
         {_money('l_extendedprice - l_quantity')} AS open,
         {_money('l_extendedprice - l_quantity')} AS high,
         {_money('l_extendedprice - l_quantity')} AS low,
         {_money('l_extendedprice - l_quantity')} AS close,
         CAST(trunc(l_quantity) AS BIGINT) AS volume,
         0 AS load
  FROM lineitem)"""

_INDEX = f"""
bars AS (
  SELECT 'VN30_INDEX' AS ticker, o_orderdate AS time,
         {_money('o_totalprice')} AS open,
         {_money('o_totalprice + 1')} AS high,
         {_money('o_totalprice - 1')} AS low,
         {_money('o_totalprice')} AS close,
         o_custkey AS volume
  FROM orders)"""

_COMPANY = f"""
company AS (
  SELECT 'C' || c_custkey AS ticker,
         c_name AS symbol,
         c_mktsegment AS exchange,
         CASE WHEN c_nationkey > 4 THEN 'nation ' || c_nationkey ELSE ' ' END AS address,
         CASE WHEN c_custkey % 4 < 2
              THEN strftime(DATE '1990-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y-%m-%d') ELSE ' ' END AS founded_date,
         strftime(DATE '2001-01-01' + CAST(c_custkey % 7000 AS INTEGER), '%Y-%m-%d') AS listing_date,
         {_money('c_acctbal + snapshot')} AS charter_capital,
         c_custkey AS number_of_employees,
         CAST(10000 AS BIGINT) AS par_value,
         CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 ELSE 0 END AS listing_price,
         c_custkey * 100 AS listed_volume,
         {_money('c_acctbal / 128')} AS free_float_percentage,
         CASE WHEN c_custkey % 7 = 0 THEN CAST(0 AS DECIMAL(20,2)) ELSE {_money('c_acctbal')} END AS free_float,
         c_custkey AS outstanding_shares,
         CAST(DATE '2024-01-01' + CAST(snapshot * 40 AS INTEGER) AS TIMESTAMP) AS as_of_date,
         'company_metadata' AS type
  FROM (SELECT *, unnest(range(0, CAST(c_custkey % 3 AS INTEGER) + 1)) AS snapshot FROM customer))"""

_LATEST_COMPANY = """
latest_company AS (
  SELECT * EXCLUDE (type) FROM company
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of_date DESC) = 1)"""

_GROUPS = """
groups AS (
  SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_nationkey < 8 THEN 'G30' ELSE 'OTHER' END AS "group"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_TRADES = f"""
trades AS (
  SELECT 'U' || user_id AS ticker, ts AS time, {_money('value')} AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS volume, event_id
  FROM events)"""

_FIVE_MINUTES = """
bars AS (
  SELECT ticker, time_bucket(INTERVAL '5 minutes', time) AS time,
         first(price ORDER BY time, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY time, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM trades GROUP BY ALL)"""

_TICKS = f"""
ticks AS (
  SELECT 'U' || user_id AS ticker, date_trunc('hour', ts) AS time,
         CASE WHEN event_id % 107 <> 0 THEN {_money('value')} END AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS volume,
         CASE WHEN event_id % 109 = 0 THEN ' ' WHEN event_type = 'signup' THEN 'ATO'
              WHEN event_type = 'error' THEN 'ATC' ELSE 'LO' END AS match_type,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS buy_vol,
         CASE WHEN event_id % 113 = 0 THEN 0 ELSE event_id % 1000 END AS sell_vol,
         ts AS ingested_at
  FROM events WHERE event_id % 101 <> 0 AND event_id % 103 <> 0)"""

_LATEST_TICKS = f"""
WITH {_TICKS}
SELECT * FROM ticks
QUALIFY row_number() OVER (PARTITION BY ticker, time ORDER BY ingested_at DESC, price DESC NULLS LAST,
                           volume DESC, match_type DESC, buy_vol DESC, sell_vol DESC) = 1"""

_FETCHED = """
fetched AS (
  SELECT 'S' || l_suppkey || '-' || (l_partkey % 40) AS ticker,
         CASE WHEN l_partkey % 211 <> 0 THEN CAST(l_shipdate AS VARCHAR) END AS time,
         l_extendedprice AS open,
         l_extendedprice + l_quantity AS high,
         CASE WHEN l_partkey % 197 = 0 THEN -l_extendedprice ELSE l_extendedprice - l_quantity END AS low,
         CASE WHEN l_partkey % 199 = 0 THEN NULL WHEN l_partkey % 193 <> 0 THEN l_extendedprice END AS close,
         l_quantity AS volume,
         'daily_price' AS type
  FROM lineitem),
failing AS (
  SELECT ticker FROM fetched GROUP BY ticker
  HAVING count(*) FILTER (time IS NULL OR close IS NULL OR open < 0 OR high < 0 OR low < 0 OR close < 0 OR volume < 0) > 0)"""


def _findings(checks: list[tuple[str, str, str]]) -> str:
    parts = [
        f"""SELECT 'daily_price' AS topic, ticker, '{check}' AS "check", '{column}' AS "column",
            count(*) FILTER ({condition}) AS count FROM fetched GROUP BY ticker"""
        for check, column, condition in checks
    ]
    return f"WITH {_FETCHED} SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


_NULL_CHECKS = [("null_violation", c, f"{c} IS NULL") for c in ("time", "open", "high", "low", "close", "volume", "ticker")]
_RANGE_CHECKS = [("below_min", c, f"{c} < 0") for c in ("open", "high", "low", "close", "volume")]
_MISTYPED_CHECKS = [
    ("missing_column", "volume", "true"),
    ("type_error", "open", "true"),
    *[c for c in _NULL_CHECKS + _RANGE_CHECKS if c[1] != "volume"],
]

_SUPPLIER_BARS = f"""
supplier_bars AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate AS time, {_money('l_extendedprice')} AS price,
         CAST(trunc(l_quantity) AS BIGINT) AS volume, l_orderkey, l_linenumber
  FROM lineitem)"""

_DAILY_BARS = """
daily_bars AS (
  SELECT ticker, CAST(time AS DATE) AS date_id,
         first(price ORDER BY time, l_orderkey, l_linenumber, price, volume) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY time, l_orderkey, l_linenumber, price, volume) AS close,
         CAST(sum(volume) AS BIGINT) AS volume
  FROM supplier_bars GROUP BY ALL)"""

_UPDATES = f"""
updates AS (
  SELECT 'C' || o_custkey AS ticker, o_orderdate AS created_at, o_orderkey, o_orderstatus, {_money('o_totalprice')} AS price
  FROM orders)"""


def _calendar(days: str) -> str:
    return f"""
calendar AS (
  SELECT CAST(d AS DATE) AS date_id, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(month(d) AS INTEGER) AS month, CAST(week(d) AS INTEGER) AS week,
         CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week,
         CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
  FROM (SELECT unnest(generate_series(min(CAST(t AS DATE)), max(CAST(t AS DATE)), INTERVAL 1 DAY)) AS d
        FROM ({days})))"""


_DAILY_CLOSES = f"""
WITH {_SUPPLIER_BARS}, {_DAILY_BARS},
closes AS (SELECT ticker, CAST(date_id AS TIMESTAMP) AS time, date_id, close FROM daily_bars)"""

_TRADE_CLOSES = f"""
WITH {_TRADES},
closes AS (SELECT ticker, time, max(price) AS close FROM trades GROUP BY ticker, time)"""


def _indicators(series: str, rsi: int, sma: int) -> str:
    return f"""{series},
steps AS (
  SELECT *, row_number() OVER w AS n, close - lag(close) OVER w AS change
  FROM closes WINDOW w AS (PARTITION BY ticker ORDER BY time)),
sums AS (
  SELECT *, sum(close) OVER (w ROWS BETWEEN {sma - 1} PRECEDING AND CURRENT ROW) AS closes,
         sum(greatest(change, 0)) OVER (w ROWS BETWEEN {rsi - 1} PRECEDING AND CURRENT ROW) AS gain,
         sum(greatest(-change, 0)) OVER (w ROWS BETWEEN {rsi - 1} PRECEDING AND CURRENT ROW) AS loss
  FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY time))
SELECT * EXCLUDE (n, change, closes, gain, loss),
       CASE WHEN n > {rsi} THEN round(CASE WHEN loss = 0 THEN 100.0
            ELSE 100.0 - 100.0 / (1.0 + CAST(gain AS DOUBLE) / CAST(loss AS DOUBLE)) END, 6) END AS rsi_{rsi},
       CASE WHEN n >= {sma} THEN round(CAST(closes AS DOUBLE) / {sma}.0, 6) END AS sma_{sma}
FROM sums"""


_MERGED_DAILY = f"""
WITH {_DAILY}, {_BACKFILL}
SELECT ticker, time, CAST(time AS DATE) AS date_id, open, high, low, close, volume
FROM (SELECT * FROM daily UNION ALL SELECT * FROM backfill)
QUALIFY row_number() OVER (PARTITION BY ticker, time
                           ORDER BY load DESC, open DESC, high DESC, low DESC, close DESC, volume DESC) = 1"""

_ONE_BAR = """QUALIFY row_number() OVER (PARTITION BY ticker, time
                           ORDER BY open DESC, high DESC, low DESC, close DESC, volume DESC) = 1"""

ORACLES: dict[str, str] = {
    "daily_price_normalize": f"""
WITH {_DAILY}
SELECT ticker, time, CAST(time AS DATE) AS date_id, open, high, low, close, volume FROM daily {_ONE_BAR}""",
    "daily_price_with_backfill": _MERGED_DAILY,
    "published_table_current": _MERGED_DAILY,
    "benchmark_index_normalize": f"""
WITH {_INDEX}
SELECT ticker, time, CAST(time AS DATE) AS date_id, open, high, low, close, volume FROM bars {_ONE_BAR}""",
    "published_partition_sizes": f"""
WITH {_INDEX}
SELECT strftime(time, '%Y%m') AS month, count(DISTINCT time) AS row_count, min(time) AS first_time, max(time) AS last_time
FROM bars GROUP BY 1""",
    "company_metadata_normalize": f"WITH {_COMPANY}, {_LATEST_COMPANY} SELECT * FROM latest_company",
    "typed_and_filled_rows": f"WITH {_COMPANY} SELECT * FROM company",
    "flexible_date_parse": f"""
WITH {_COMPANY}
SELECT nullif(founded_date, ' ') AS founded_date, count(*) AS companies FROM company GROUP BY 1""",
    "ticker_list_normalize": f"WITH {_GROUPS} SELECT DISTINCT * FROM groups",
    "financial_ratio_normalize": f"""
SELECT 'P' || (p_partkey // 20) AS ticker, CAST(2015 + p_size % 5 AS INTEGER) AS year,
       CASE WHEN p_partkey % 5 = 4 THEN 'Yearly' ELSE 'Q' || (p_partkey % 5 + 1) END AS quarter,
       {_money('p_retailprice / 8', 4)} AS pe,
       CASE WHEN p_size > 3 THEN {_money('p_retailprice / 512', 4)} ELSE CAST(0 AS DECIMAL(20,4)) END AS pb,
       {_money('CAST(p_size AS DOUBLE)', 4)} AS ev_ebitda,
       {_money('p_size / 128', 4)} AS roe
FROM part
QUALIFY row_number() OVER (PARTITION BY ticker, year, quarter ORDER BY pe DESC, pb DESC, ev_ebitda DESC, roe DESC) = 1""",
    "intraday_price_normalize": f"""
WITH {_TRADES}, {_FIVE_MINUTES}
SELECT ticker, time, CAST(time AS DATE) AS date_id, open, high, low, close, volume FROM bars""",
    "json_lake_scan": f"""
WITH {_TICKS}
SELECT ticker, CAST(time AS VARCHAR) AS time, CAST(price AS VARCHAR) AS price, volume, match_type, buy_vol, sell_vol FROM ticks""",
    "hour_partition_scan": f"""
WITH {_TRADES}
SELECT strftime(time, '%Y-%m-%d_%H') AS dt_hour, count(*) AS records, sum(price) AS price_sum, CAST(sum(volume) AS BIGINT) AS volume
FROM trades GROUP BY 1""",
    "validated_landing": f"""
WITH {_FETCHED}
SELECT ticker, CAST(time AS TIMESTAMP) AS time, CAST(time AS DATE) AS date_id,
       {_money('open')} AS open, {_money('high')} AS high, {_money('low')} AS low, {_money('close')} AS close,
       CAST(trunc(volume) AS BIGINT) AS volume
FROM fetched ANTI JOIN failing USING (ticker)
QUALIFY row_number() OVER (PARTITION BY ticker, time
                           ORDER BY {_money('open')} DESC, {_money('high')} DESC, {_money('low')} DESC,
                                    {_money('close')} DESC, volume DESC) = 1""",
    "keyed_replace_latest": f"""
WITH {_UPDATES}
SELECT * FROM updates
QUALIFY row_number() OVER (PARTITION BY ticker
        ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END DESC, created_at DESC, o_orderkey DESC) = 1""",
    "keyed_replace_by_version": f"""
WITH {_UPDATES}
SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, o_orderkey DESC) = 1""",
    "versioned_history": f"""
WITH {_UPDATES}
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at, o_orderkey) AS version FROM updates""",
    "quality_report_daily": _findings(_NULL_CHECKS + _RANGE_CHECKS),
    "quality_report_mistyped": _findings(_MISTYPED_CHECKS),
    "quality_gate": f"WITH {_FETCHED} SELECT * FROM fetched ANTI JOIN failing USING (ticker)",
    "quality_quarantine": f"""
WITH {_FETCHED}
SELECT ticker, count(*) AS row_count, CAST(8 AS INTEGER) AS column_count
FROM fetched SEMI JOIN failing USING (ticker) GROUP BY ticker""",
    "group_member_filter": f"""
WITH {_SUPPLIER_BARS}, {_GROUPS}
SELECT * FROM supplier_bars WHERE ticker IN (SELECT ticker FROM groups WHERE "group" = 'G30')""",
    "group_ticker_rows": """
SELECT 'S' || s_suppkey AS ticker, 'VN30' AS "group", 'ticker_list' AS type FROM supplier""",
    "lookback_filter": f"""
WITH {_SUPPLIER_BARS}
SELECT * FROM supplier_bars WHERE CAST(time AS DATE) BETWEEN DATE '2001-06-13' AND DATE '2001-06-15'""",
    "backfill_range_filter": """
SELECT event_id, ts AS time, user_id, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2015-01-01' AND DATE '2024-01-20'""",
    "ticker_high_water": f"WITH {_TRADES} SELECT ticker, max(time) AS last_time FROM trades GROUP BY ticker",
    "incremental_high_water": f"""
WITH {_TRADES}, marks AS (SELECT ticker, max(time) AS last_time FROM trades WHERE time < TIMESTAMP '2024-01-15' GROUP BY ticker)
SELECT trades.* FROM trades LEFT JOIN marks USING (ticker) WHERE last_time IS NULL OR time > last_time""",
    "kafka_payload_encode": f"""
WITH {_TRADES}
SELECT ticker AS key,
       '{{"ticker":"' || ticker || '","time":"' || CAST(time AS VARCHAR) || '","price":"' || CAST(price AS VARCHAR)
       || '","volume":' || volume || ',"event_id":' || event_id || '}}' AS value
FROM trades""",
    "tick_parse_and_type": f"WITH {_TICKS} SELECT * FROM ticks",
    "tick_batch_latest": _LATEST_TICKS,
    "tick_stream_latest": _LATEST_TICKS,
    "raw_archive_roundtrip": """
SELECT event_id, user_id, value, event_type,
       CASE event_type WHEN 'click' THEN 'benchmark_index' WHEN 'error' THEN 'company_metadata'
            WHEN 'purchase' THEN 'daily_price' WHEN 'signup' THEN 'daily_price_backfill'
            ELSE CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'ticker_list' ELSE 'intraday_price' END END AS topic,
       true AS is_stamped
FROM events""",
    "incremental_tick_stream": f"""
WITH {_TRADES}
SELECT *, CAST(CASE WHEN time < TIMESTAMP '2024-01-11' THEN 0 WHEN time < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS BIGINT) AS batch_id
FROM trades""",
    "tick_stream_new": f"WITH {_TRADES} SELECT DISTINCT * FROM trades",
    "tick_stream_deduplicated": f"""
WITH {_TICKS}, keys AS (SELECT DISTINCT ticker, time FROM ticks),
newest AS (SELECT ticker, max(time) AS latest FROM keys GROUP BY ticker)
SELECT ticker, time, false AS is_late FROM keys
UNION ALL SELECT ticker, time, true FROM keys JOIN newest USING (ticker)
WHERE time < TIMESTAMP '2024-01-16' AND time <= latest - INTERVAL 1 DAY""",
    "tick_stream_bars": f"WITH {_TRADES}, {_FIVE_MINUTES} SELECT * FROM bars",
    "dim_date_build": f"WITH {_calendar('SELECT o_orderdate AS t FROM orders')} SELECT * FROM calendar",
    "star_join_monthly": f"""
WITH {_UPDATES}, {_COMPANY}, {_LATEST_COMPANY}, {_calendar('SELECT created_at AS t FROM updates')}
SELECT year, month, exchange, sum(price) AS turnover, count(*) AS trades
FROM updates JOIN calendar ON CAST(created_at AS DATE) = date_id LEFT JOIN latest_company USING (ticker)
GROUP BY year, month, exchange""",
    "star_join_group": f"""
WITH {_SUPPLIER_BARS}, {_DAILY_BARS}, {_GROUPS}, {_calendar('SELECT date_id AS t FROM daily_bars')}
SELECT "group", day_of_week, is_weekend, count(*) AS bars, max(high) AS high, min(low) AS low, CAST(sum(volume) AS BIGINT) AS volume
FROM daily_bars JOIN calendar USING (date_id) LEFT JOIN groups USING (ticker)
GROUP BY "group", day_of_week, is_weekend""",
    "ohlcv_bars_5m": f"WITH {_TRADES}, {_FIVE_MINUTES} SELECT * FROM bars",
    "ohlcv_bars_daily": f"WITH {_SUPPLIER_BARS}, {_DAILY_BARS} SELECT * FROM daily_bars",
    "indicators_long_term": _indicators(_DAILY_CLOSES, 14, 200),
    "indicators_short_term": _indicators(_DAILY_CLOSES, 3, 10),
    "indicators_of_trades": _indicators(_TRADE_CLOSES, 3, 10),
    "company_history_scd2": f"""
WITH {_COMPANY}
SELECT ticker, as_of_date, charter_capital, exchange,
       row_number() OVER (PARTITION BY ticker ORDER BY as_of_date) AS version,
       lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) AS valid_to,
       lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) IS NULL AS is_current
FROM company""",
    "company_history_same_day": f"""
WITH {_COMPANY}
SELECT ticker, as_of_date, CAST(charter_capital + 1 AS DECIMAL(20,2)) AS charter_capital, exchange,
       row_number() OVER (PARTITION BY ticker ORDER BY as_of_date) AS version,
       lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) AS valid_to,
       lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) IS NULL AS is_current
FROM company""",
    "company_history_published": f"""
WITH {_COMPANY}
SELECT ticker, as_of_date AS valid_from, lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) AS valid_to,
       row_number() OVER (PARTITION BY ticker ORDER BY as_of_date) AS version,
       lead(as_of_date) OVER (PARTITION BY ticker ORDER BY as_of_date) IS NULL AS is_current,
       CAST(charter_capital + 1 AS DECIMAL(30,2)) AS charter_capital, exchange
FROM company""",
    "incremental_backlog": f"WITH {_TRADES} SELECT * FROM trades",
    "published_corrections": f"""
WITH {_COMPANY}, {_LATEST_COMPANY}
SELECT ticker, as_of_date, CAST(charter_capital - 1 AS DECIMAL(30,2)) AS charter_capital, exchange FROM latest_company""",
}
# The same results by another cut of the rows.
ORACLES |= {f"{name}_cut": ORACLES[name] for name in ("versioned_history", "indicators_of_trades")}

# Jobs publish what normalizing gives, in the declared columns of the table.
_BARS = "ticker, time, date_id, open, high, low, close, volume"
ORACLES |= {
    "daily_price_job": f"SELECT {_BARS} FROM ({ORACLES['daily_price_normalize']})",
    "daily_price_backfill_job": f"SELECT {_BARS} FROM ({ORACLES['daily_price_with_backfill']})",
    "benchmark_index_job": f"SELECT {_BARS} FROM ({ORACLES['benchmark_index_normalize']})",
    "intraday_price_job": f"SELECT {_BARS} FROM ({ORACLES['intraday_price_normalize']})",
    "ticker_list_job": ORACLES["ticker_list_normalize"],
    "company_metadata_job": f"""
SELECT ticker, symbol, exchange, founded_date, CAST(charter_capital AS DECIMAL(30,2)) AS charter_capital, listing_price, as_of_date
FROM ({ORACLES['company_metadata_normalize']})""",
    "financial_ratio_job": f"""
SELECT ticker, year, quarter, pe, pb, CAST(NULL AS DECIMAL(20,4)) AS ps, ev_ebitda, roe FROM ({ORACLES['financial_ratio_normalize']})""",
}

ORACLES |= {
    "compacted_plus_later_loads": f"""
SELECT {_BARS.replace(', volume', '')}, CASE WHEN ticker IN (SELECT ticker FROM (SELECT DISTINCT ticker FROM ({ORACLES['daily_price_normalize']})) WHERE CAST(substr(ticker, 2) AS INTEGER) % 3 = 0)
       AND (ticker, time) IN (SELECT (ticker, time) FROM ({ORACLES['daily_price_normalize']})) THEN volume + 1 ELSE volume END AS volume
FROM ({ORACLES['published_table_current']})""",
    "compacted_then_replayed": f"""
WITH newest AS ({ORACLES['daily_price_normalize']}), oldest AS (
  WITH {_BACKFILL} SELECT ticker, time, CAST(time AS DATE) AS date_id, open, high, low, close, volume FROM backfill {_ONE_BAR})
SELECT * REPLACE (volume + 1 AS volume) FROM newest
UNION ALL SELECT * REPLACE (CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 5 = 0 THEN volume + 10 ELSE volume END AS volume)
FROM oldest ANTI JOIN newest USING (ticker, time)""",
    "later_hour_wins": f"SELECT ticker, time, open FROM ({ORACLES['daily_price_normalize']}) WHERE time > TIMESTAMP '1970-01-01'",
    "published_row_counts": f"""
SELECT 'ticker_list' AS topic, count(*) AS reported FROM ({ORACLES['ticker_list_normalize']})
UNION ALL SELECT 'company_metadata', count(*) FROM ({ORACLES['company_metadata_normalize']})
UNION ALL SELECT 'daily_price', count(*) FROM ({ORACLES['daily_price_normalize']})""",
    "ingest_time_default": f"""
WITH {_TRADES}
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN time END AS ingested_at, event_id % 3 = 0 AS filled FROM trades""",
    "indicators_short_term_incremental": ORACLES["indicators_short_term"],
    "indicators_short_term_appended": ORACLES["indicators_short_term"],
    "indicators_long_term_appended": ORACLES["indicators_long_term"],
    "star_join_bucketed": ORACLES["star_join_monthly"],
    "quality_counts_rolled_up": ORACLES["quality_report_daily"],
    "lake_schema_drift": """
WITH hours AS (SELECT '2024-02-01_0' || (event_id % 3) AS dt_hour, event_id % 3 AS h, count(*) AS records FROM events GROUP BY ALL),
fields(h, field, type) AS (VALUES
  (0, 'ticker', 'STRING'), (0, 'event_id', 'BIGINT'), (0, 'extra', 'STRING'),
  (1, 'ticker', 'STRING'), (1, 'event_id', 'BIGINT'), (1, 'extra', 'BIGINT'), (1, 'volume', 'BIGINT'),
  (2, 'event_id', 'STRING'), (2, 'extra', 'BIGINT'), (2, 'volume', 'BIGINT')),
every AS (SELECT h.h, dt_hour, records, f.field FROM hours h, (SELECT DISTINCT field FROM fields) f),
compared AS (
  SELECT e.dt_hour, e.field, now.type, CASE WHEN now.type IS NOT NULL THEN e.records END AS records,
         CASE WHEN e.h = 0 THEN NULL WHEN was.type IS NULL THEN 'new' WHEN now.type IS NULL THEN 'lost' WHEN was.type <> now.type THEN 'retyped' END AS change,
         was.type AS before
  FROM every e LEFT JOIN fields now ON now.h = e.h AND now.field = e.field LEFT JOIN fields was ON was.h = e.h - 1 AND was.field = e.field
  WHERE now.type IS NOT NULL OR was.type IS NOT NULL)
SELECT dt_hour, field, type, records, change, CASE WHEN change IS NOT NULL THEN before END AS was FROM compared""",
    "raw_archive_compacted": ORACLES["raw_archive_roundtrip"],
    "company_history_appended": ORACLES["company_history_published"],
}
