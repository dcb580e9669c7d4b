"""Moving averages and relative strength over each ticker's closes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import number_rows, with_halo

BLOCK_ROWS = 8192


def _trailing(running: str, rows: int, along) -> Column:
    """Sum of the last ``rows`` rows, from the running sum: no frame is re-read."""
    return F.col(running) - F.coalesce(F.lag(running, rows).over(along), F.lit(0))


def _add_indicators(df: DataFrame, group: Sequence[str], sma: Sequence[int], rsi: Sequence[int]) -> DataFrame:
    """Indicators of rows numbered by ``_position``, windowed within ``group``.

    Sums are kept in decimals, so they are exact wherever a group begins.
    """
    along = Window.partitionBy(*group).orderBy("time")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    change = F.coalesce(F.col("close") - F.lag("close").over(along), F.lit(0))
    moves = df.withColumn("_change", change).withColumns(
        {
            "_gain": F.greatest(F.col("_change"), F.lit(0)),
            "_loss": F.greatest(-F.col("_change"), F.lit(0)),
        }
    )
    sums = moves.withColumns(
        {
            "_sum_close": F.sum("close").over(so_far),
            "_sum_gain": F.sum("_gain").over(so_far),
            "_sum_loss": F.sum("_loss").over(so_far),
        }
    )
    trailing = sums.withColumns(
        {
            **{f"_close_{n}": _trailing("_sum_close", n, along) for n in sma},
            **{f"_gain_{n}": _trailing("_sum_gain", n, along) for n in rsi},
            **{f"_loss_{n}": _trailing("_sum_loss", n, along) for n in rsi},
        }
    )

    def sma_value(n: int) -> Column:
        return F.when(F.col("_position") >= n, F.col(f"_close_{n}").cast("double") / F.lit(float(n)))

    def rsi_value(n: int) -> Column:
        gain, loss = F.col(f"_gain_{n}").cast("double"), F.col(f"_loss_{n}").cast("double")
        strength = F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
        return F.when(F.col("_position") > n, strength)

    return trailing.withColumns(
        {**{f"rsi_{n}": rsi_value(n) for n in rsi}, **{f"sma_{n}": sma_value(n) for n in sma}}
    )


def moving_indicators(
    df: DataFrame,
    sma: Sequence[int] = (),
    rsi: Sequence[int] = (),
    one_per_day: bool = False,
    block_rows: int = BLOCK_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``sma_<n>`` and ``rsi_<n>`` to rows of (ticker, time, close, ...).

    ``(ticker, time)`` must be unique. A value is null until its window is full.
    RSI uses plain averages of the last n gains and losses, and is 100 where
    there was no loss.

    Rows are numbered and cut into blocks with a halo, so a ticker may have any number of them. Pass
    ``one_per_day`` for daily bars: a ticker then has as many rows as the calendar
    has days (a century is 36,525), so one window per ticker is bounded and one shuffle is enough.
    """
    out = [*df.columns, *[f"rsi_{n}" for n in rsi], *[f"sma_{n}" for n in sma]]
    if one_per_day:
        position = F.row_number().over(Window.partitionBy("ticker").orderBy("time"))
        return _add_indicators(df.withColumn("_position", position), ["ticker"], sma, rsi).select(*out)

    reach = max([1, *[n - 1 for n in sma], *rsi])
    numbered = number_rows(df, ["ticker"], ["time"], name="_position", ranges=ranges)
    blocks = with_halo(numbered, "_position", max(block_rows, reach), reach)
    return _add_indicators(blocks, ["ticker", "_block"], sma, rsi).where("_own").select(*out)
