"""Daily bars: split adjustment, bad-price flags, casts and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import flag, safe_divide
from quotemill.operators.rolling import near_flag
from quotemill.operators.series import DAILY, Series
from quotemill.schemas import BAD_PRICE_LOOKBACK, LABEL_HORIZON, MAX_DAILY_MOVE

PRICE_TYPES = {
    "date": "timestamp_ntz",
    "volume": "bigint",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "adj_close": "double",
}


def cast_prices(df: DataFrame) -> DataFrame:
    """Strict casts to the price types; a value that does not parse is an error."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in PRICE_TYPES.items()})


def positive_prices(df: DataFrame) -> DataFrame:
    return df.where((F.col("adj_close") > 0) & (F.col("close") > 0))


def adjust_prices(df: DataFrame) -> DataFrame:
    """Open, high and low rescaled by the close's adjustment."""
    return df.withColumns(
        {
            f"adj_{c}": safe_divide(F.col(c) * F.col("adj_close"), F.col("close"))
            for c in ("open", "high", "low")
        }
    )


def stock_prices(raw: DataFrame) -> DataFrame:
    """Raw bars to the price table: symbol, date, volume, raw and adjusted prices."""
    return adjust_prices(positive_prices(cast_prices(raw))).select(
        "symbol", "date", "volume", "open", "high", "low", "close", "adj_close",
        "adj_open", "adj_high", "adj_low",
    )


def from_date(df: DataFrame, start_date: str | None) -> DataFrame:
    if start_date is None:
        return df
    return df.where(F.col("date") >= F.lit(start_date).cast("timestamp_ntz"))


def bad_day(series: Series = DAILY, max_daily_move: float = MAX_DAILY_MOVE) -> Column:
    """A close or open that is too far above the previous close."""
    previous = series.lag("adj_close")
    return flag(F.try_divide(F.col("adj_close"), previous) - 1 > max_daily_move) | flag(
        F.try_divide(F.col("adj_open"), previous) - 1 > max_daily_move
    )


def flag_bad_prices(
    df: DataFrame,
    series: Series = DAILY,
    max_daily_move: float = MAX_DAILY_MOVE,
    lookback_rows: int = BAD_PRICE_LOOKBACK,
    horizon: int = LABEL_HORIZON,
) -> DataFrame:
    """Add ``near_bad_price``: a bad day in this row, the look-back rows or the label window."""
    flagged = df.withColumn("_bad", bad_day(series, max_daily_move))
    return near_flag(flagged, series, "_bad", lookback_rows, horizon + 1, "near_bad_price").drop("_bad")


def sorted_by_symbol_date(df: DataFrame) -> DataFrame:
    """Global (symbol, date) order: range partitions, each sorted, so files are in order too."""
    return df.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date")
