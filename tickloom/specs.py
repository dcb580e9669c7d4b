"""What distinguishes one dataset from another: names, keys, types, rules.

Everything else (reading, trimming, filling, de-duplicating, publishing) is the
same for all of them and lives in ``plans`` and ``streaming``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.casts import MONEY, RATIO, has_column, retype
from tickloom.functions.temporal import flexible_date

# --- Fixed values: target tables (column order and types of the warehouse) ---

_OHLCV_COLUMNS = (
    ("ticker", "string"),
    ("time", "timestamp"),
    ("date_id", "date"),
    ("open", "decimal(20,2)"),
    ("high", "decimal(20,2)"),
    ("low", "decimal(20,2)"),
    ("close", "decimal(20,2)"),
    ("volume", "bigint"),
)

_COMPANY_COLUMNS = (
    ("ticker", "string"),
    ("symbol", "string"),
    ("business_model", "string"),
    ("founded_date", "string"),
    ("charter_capital", "decimal(30,2)"),
    ("number_of_employees", "bigint"),
    ("listing_date", "string"),
    ("par_value", "bigint"),
    ("exchange", "string"),
    ("listing_price", "bigint"),
    ("listed_volume", "bigint"),
    ("ceo_name", "string"),
    ("ceo_position", "string"),
    ("inspector_name", "string"),
    ("inspector_position", "string"),
    ("establishment_license", "string"),
    ("business_code", "string"),
    ("tax_id", "string"),
    ("auditor", "string"),
    ("company_type", "string"),
    ("address", "string"),
    ("phone", "string"),
    ("fax", "string"),
    ("email", "string"),
    ("website", "string"),
    ("branches", "string"),
    ("history", "string"),
    ("free_float_percentage", "decimal(10,4)"),
    ("free_float", "decimal(30,2)"),
    ("outstanding_shares", "bigint"),
    ("as_of_date", "timestamp"),
)

_HISTORY_COLUMNS = (
    *((name, kind) for name, kind in _COMPANY_COLUMNS if name != "as_of_date"),
    ("valid_from", "timestamp"),
    ("valid_to", "timestamp"),
    ("version", "bigint"),
    ("is_current", "boolean"),
)

RATIO_METRICS = (
    "pe",
    "pb",
    "ps",
    "ev_ebitda",
    "roe",
    "roa",
    "eps",
    "net_profit_margin",
    "gross_profit_margin",
    "asset_turnover",
    "current_ratio",
    "debt_to_equity",
)

_RATIO_COLUMNS = (
    ("ticker", "string"),
    ("year", "int"),
    ("quarter", "string"),
    *((metric, RATIO) for metric in RATIO_METRICS),
)

_TICK_COLUMNS = (
    ("ticker", "string"),
    ("time", "timestamp"),
    ("price", "decimal(20,2)"),
    ("volume", "bigint"),
    ("match_type", "string"),
    ("buy_vol", "bigint"),
    ("sell_vol", "bigint"),
    ("ingested_at", "timestamp"),
)


@dataclass(frozen=True)
class TableSpec:
    """A published table: one row per ``keys``."""

    name: str
    columns: tuple[tuple[str, str], ...]
    keys: tuple[str, ...]
    # Column whose month or day the files are split by, and that grain.
    partition_time: str | None = None
    partition_grain: str = "month"
    # Newest value of these columns wins among rows with the same key.
    version: tuple[str, ...] = ()


TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec("dim_ticker", (("ticker", "string"), ("group", "string")), ("ticker",)),
        TableSpec("dim_company", _COMPANY_COLUMNS, ("ticker",), version=("as_of_date",)),
        TableSpec("dim_company_history", _HISTORY_COLUMNS, ("ticker", "valid_from")),
        # The open interval of each company: what the next snapshots are merged with.
        TableSpec("dim_company_open", _HISTORY_COLUMNS, ("ticker",)),
        TableSpec(
            "dim_date",
            (
                ("date_id", "date"),
                ("year", "int"),
                ("quarter", "int"),
                ("month", "int"),
                ("week", "int"),
                ("day_of_month", "int"),
                ("day_of_week", "int"),
                ("is_weekend", "int"),
            ),
            ("date_id",),
        ),
        TableSpec("fact_daily_price", _OHLCV_COLUMNS, ("ticker", "time"), "time"),
        TableSpec("fact_benchmark_index", _OHLCV_COLUMNS, ("ticker", "time"), "time"),
        TableSpec("fact_intraday_price", _OHLCV_COLUMNS, ("ticker", "time"), "time", "day"),
        TableSpec("fact_financial_ratio", _RATIO_COLUMNS, ("ticker", "year", "quarter")),
        TableSpec("fact_intraday_tick", _TICK_COLUMNS, ("ticker", "time"), "time", "day", ("ingested_at",)),
        TableSpec(
            "technical_indicators_historical",
            (
                ("ticker", "string"),
                ("time", "timestamp"),
                ("date_id", "date"),
                ("close", "decimal(20,2)"),
                ("rsi_14", "double"),
                ("sma_200", "double"),
                ("calculated_at", "timestamp"),
            ),
            ("ticker", "time"),
            "time",
            version=("calculated_at",),
        ),
        TableSpec(
            "technical_indicators_daily",
            (
                ("ticker", "string"),
                ("time", "timestamp"),
                ("date_id", "date"),
                ("close", "decimal(20,2)"),
                ("rsi_3", "double"),
                ("sma_10", "double"),
                ("calculated_at", "timestamp"),
            ),
            ("ticker", "time"),
            "time",
            version=("calculated_at",),
        ),
        TableSpec(
            "quality_counts",
            (("topic", "string"), ("dt_hour", "string"), ("ticker", "string"), ("check", "string"), ("column", "string"), ("count", "bigint")),
            ("topic", "dt_hour", "ticker", "check", "column"),
        ),
        # The closes that the next day's windows reach back to.
        TableSpec(
            "indicator_tail",
            (("ticker", "string"), ("latest", "timestamp"), ("closes", "array<struct<time:timestamp,close:decimal(20,2)>>")),
            ("ticker",),
        ),
    )
}

# --- Per-dataset typing ------------------------------------------------------


def type_ohlcv(df: DataFrame) -> DataFrame:
    """Price bars: time and its date, two-digit prices, whole volume."""
    typed = retype(
        df,
        {"time": "timestamp", "open": MONEY, "high": MONEY, "low": MONEY, "close": MONEY, "volume": "bigint"},
    )
    return typed.withColumn("date_id", F.to_date("time"))


def type_company(df: DataFrame) -> DataFrame:
    """Company profile: money and share counts, mixed date spellings."""
    typed = retype(
        df,
        {
            "charter_capital": MONEY,
            "number_of_employees": "bigint",
            "par_value": "bigint",
            "listing_price": "bigint",
            "listed_volume": "bigint",
            "free_float_percentage": MONEY,
            "free_float": MONEY,
            "outstanding_shares": "bigint",
            "as_of_date": "timestamp",
        },
    )
    dates = [c for c in ("founded_date", "listing_date") if has_column(typed, c)]
    return typed.withColumns({c: flexible_date(F.col(c)) for c in dates})


def type_ratio(df: DataFrame) -> DataFrame:
    """Financial ratios: whichever of the metrics the source delivered."""
    return retype(df, {"year": "int", "quarter": "string", **dict.fromkeys(RATIO_METRICS, RATIO)})


def type_nothing(df: DataFrame) -> DataFrame:
    """Dimensions whose columns are text already."""
    return df


# --- Raw topics --------------------------------------------------------------

_BAR_FIELDS = ("time", "open", "high", "low", "close", "volume", "ticker")


def _text_schema(*names: str) -> str:
    """Raw values are read as their JSON text and typed afterwards."""
    return ", ".join(f"`{n}` string" for n in (*names, "type", "kafka_ingested_at"))


@dataclass(frozen=True)
class DatasetSpec:
    """One raw topic, the table it feeds, and how its rows are typed."""

    topic: str
    table: str
    raw_schema: str
    transform: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...] = ("ticker", "time")
    # Newest value of these columns wins; the rest of the row breaks ties.
    stamp: tuple[str, ...] = ("kafka_ingested_at", "dt_hour")
    fill_numeric: bool = True
    # Field names come in any case, and the ``optional`` ones may be wholly absent.
    any_case: bool = False
    optional: tuple[str, ...] = ()


DATASETS: dict[str, DatasetSpec] = {
    spec.topic: spec
    for spec in (
        DatasetSpec("ticker_list", "dim_ticker", _text_schema("ticker", "group"), type_nothing, ("ticker",)),
        DatasetSpec(
            "company_metadata",
            "dim_company",
            _text_schema(*(name for name, _ in _COMPANY_COLUMNS)),
            type_company,
            ("ticker",),
            ("as_of_date", "kafka_ingested_at", "dt_hour"),
        ),
        DatasetSpec("daily_price", "fact_daily_price", _text_schema(*_BAR_FIELDS), type_ohlcv),
        DatasetSpec("daily_price_backfill", "fact_daily_price", _text_schema(*_BAR_FIELDS), type_ohlcv),
        DatasetSpec("benchmark_index", "fact_benchmark_index", _text_schema(*_BAR_FIELDS), type_ohlcv),
        DatasetSpec("intraday_price", "fact_intraday_price", _text_schema(*_BAR_FIELDS), type_ohlcv),
        DatasetSpec(
            "financial_ratio",
            "fact_financial_ratio",
            _text_schema("ticker", "year", "quarter", *RATIO_METRICS),
            type_ratio,
            ("ticker", "year", "quarter"),
            any_case=True,
            optional=RATIO_METRICS,
        ),
    )
}

# The tick message, and the topics archived to the lake.
TICK_TOPIC = "intraday_tick"
TICK_SCHEMA = ", ".join(
    f"{name} string"
    for name in ("ticker", "time", "price", "volume", "match_type", "buy_vol", "sell_vol", "ingested_at")
)
ARCHIVED_TOPICS = (
    "benchmark_index",
    "company_metadata",
    "daily_price",
    "daily_price_backfill",
    "intraday_price",
    "ticker_list",
)

# --- Quality rules -----------------------------------------------------------


@dataclass(frozen=True)
class QualitySpec:
    """What a batch must satisfy before it may land.

    ``kinds`` maps a column to the accepted kinds: ``f`` float, ``i`` whole
    number, ``O`` text. Bounds are inclusive and ``None`` means unbounded.
    """

    required: tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


# The rules of each topic.
_PRICES = ("open", "high", "low", "close")
_BAR_KINDS = {**dict.fromkeys(_PRICES, "f"), "volume": "fi", "ticker": "O"}
_FROM_ZERO = (0, None)

QUALITY: dict[str, QualitySpec] = {
    "daily_price": QualitySpec(
        required=_BAR_FIELDS,
        kinds=_BAR_KINDS,
        not_null=_BAR_FIELDS,
        ranges=dict.fromkeys((*_PRICES, "volume"), _FROM_ZERO),
    ),
    "intraday_price": QualitySpec(
        required=_BAR_FIELDS,
        kinds=_BAR_KINDS,
        not_null=("time", *_PRICES, "ticker"),
        ranges=dict.fromkeys((*_PRICES, "volume"), _FROM_ZERO),
    ),
    "benchmark_index": QualitySpec(
        required=_BAR_FIELDS,
        kinds=_BAR_KINDS,
        not_null=("time", *_PRICES, "ticker"),
        ranges=dict.fromkeys(_PRICES, _FROM_ZERO),
    ),
    "ticker_list": QualitySpec(
        required=("ticker", "group", "type"),
        kinds=dict.fromkeys(("ticker", "group", "type"), "O"),
        not_null=("ticker", "group"),
    ),
    "company_metadata": QualitySpec(required=("ticker",), kinds={"ticker": "O"}, not_null=("ticker",)),
    "financial_ratio": QualitySpec(
        required=("ticker", "year", "quarter"),
        kinds={"ticker": "O", "year": "fi", "quarter": "O", **dict.fromkeys(RATIO_METRICS, "f")},
        not_null=("ticker", "year", "quarter"),
        ranges={"pe": (None, None), "pb": (None, None)},
    ),
}

# The index symbol as the market names it and as it is stored,
# the default history start, and the days an incremental load looks back.
INDEX_LABELS = {"VN30": "VN30_INDEX"}
BACKFILL_START = "2015-01-01"
LOOKBACK_DAYS = 2
