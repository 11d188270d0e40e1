"""Returns, moving averages, volatility and momentum on unadjusted closes by timestamp.

Unlike the indicator registry, rolling frames may be partial and the cross is a state. A timestamp
series has no calendar bound, so long series are split first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import flag, safe_divide
from quotemill.operators.series import ROWS_PER_PART, Series, home_rows, split_series

BY_TIME = Series(("symbol",), "timestamp", bounded=False)
LONGEST_FRAME = 200
REQUIRED = ["timestamp", "close", "volume", "symbol"]


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same one on every run: the smallest by the other columns."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in others]).select(*df.columns)


def clean_bars(df: DataFrame) -> DataFrame:
    """Complete rows, one per symbol and timestamp: the smallest by the other columns."""
    return first_per_key(df.dropna(subset=REQUIRED), ["symbol", "timestamp"])


def _split(df: DataFrame, rows_per_part: int) -> tuple[DataFrame, Series]:
    return split_series(df, BY_TIME, rows_per_part, back=LONGEST_FRAME + 14, ahead=1)


def daily_return(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    parts, series = _split(df, rows_per_part)
    return home_rows(_with_return(parts, series))


def _with_return(df: DataFrame, series: Series) -> DataFrame:
    previous = F.col("prev_close")
    return df.withColumn("prev_close", series.lag("close")).withColumn(
        "daily_return", safe_divide(F.col("close") - previous, previous)
    )


def moving_averages(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    parts, series = _split(df, rows_per_part)
    averaged = parts.withColumns(
        {f"sma_{n}": F.avg("close").over(series.trailing(n)) for n in (20, 50, 200)}
    )
    above = flag(F.col("sma_50") > F.col("sma_200"))
    return home_rows(averaged).withColumn("golden_cross", above.cast("bigint"))


def volatility(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    parts, series = _split(df, rows_per_part)
    returned = _with_return(parts, series)
    return home_rows(
        returned.withColumns(
            {
                f"volatility_{n}d": F.stddev("daily_return").over(series.trailing(n))
                for n in (14, 21)
            }
        )
    )


def momentum(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    parts, series = _split(df, rows_per_part)
    shifted = home_rows(
        parts.withColumns({f"close_{n}d_ago": series.lag("close", n) for n in (7, 14)})
    )
    return shifted.withColumns(
        {
            f"momentum_{n}d": safe_divide(
                F.col("close") - F.col(f"close_{n}d_ago"), F.col(f"close_{n}d_ago")
            )
            for n in (7, 14)
        }
    )
