"""Volatility-scaled labels, class weights and the metrics dataset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import rating_of, single_row, to_float32
from quotemill.operators.buckets import BOUNDED
from quotemill.operators.ewm import with_ewm_std
from quotemill.operators.series import DAILY, Series, home_rows, numbered, split_series
from quotemill.plans.indicators import compute_stock_indicators
from quotemill.plans.market import compute_market_indicators
from quotemill.plans.prices import flag_bad_prices
from quotemill.session import staged
from quotemill.schemas import (
    BAD_PRICE_LOOKBACK,
    INDICATOR_NAMES,
    LABEL_HORIZON,
    MARKET_INDICATOR_NAMES,
    MAX_DAILY_MOVE,
    MAX_SPAN_DAYS,
)

# Threshold scale and the span of the volatility estimate.
THRESHOLD_SCALE = 0.5
VOLATILITY_SPAN = 21
LABEL_COLUMNS = ["forward_return", "label_end_date", "trailing_return", "threshold", "label"]


def with_forward_return(
    df: DataFrame,
    series: Series = DAILY,
    horizon: int = LABEL_HORIZON,
    max_span_days: int = MAX_SPAN_DAYS,
) -> DataFrame:
    """Add ``forward_return`` and ``label_end_date``.

    The trade enters at the next row's open and leaves ``horizon`` rows later at the open. The
    return is missing where an open is not positive or the exit is too many days ahead.
    """
    opening = df.withColumn("_open", F.when(F.col("adj_open") > 0, F.col("adj_open")))
    end = series.lead(series.order, horizon + 1)
    change = F.log(F.try_divide(series.lead("_open", horizon + 1), series.lead("_open", 1)))
    return opening.withColumns(
        {
            "label_end_date": end,
            "forward_return": F.when(_days(end, F.col(series.order)) <= max_span_days, change),
        }
    ).drop("_open")


def with_trailing_return(
    df: DataFrame,
    series: Series = DAILY,
    horizon: int = LABEL_HORIZON,
    max_span_days: int = MAX_SPAN_DAYS,
) -> DataFrame:
    """Add ``trailing_return``, the log return of the past ``horizon`` rows."""
    start = series.lag(series.order, horizon)
    change = F.log(F.try_divide(F.col("adj_close"), series.lag("adj_close", horizon)))
    return df.withColumn(
        "trailing_return", F.when(_days(F.col(series.order), start) <= max_span_days, change)
    )


def with_threshold(
    df: DataFrame,
    series: Series = DAILY,
    horizon: int = LABEL_HORIZON,
    scale: float = THRESHOLD_SCALE,
) -> DataFrame:
    """Add ``threshold``: the scaled volatility of daily log returns over the horizon."""
    daily = F.log(F.try_divide(F.col("adj_close"), series.lag("adj_close")))
    spread = with_ewm_std(
        df.withColumn("_log_return", daily), series, "_log_return", VOLATILITY_SPAN, VOLATILITY_SPAN, "_spread"
    )
    return spread.withColumn(
        "threshold", F.lit(scale) * F.col("_spread") * F.lit(math.sqrt(horizon))
    ).drop("_log_return", "_spread")


def label_stock(
    df: DataFrame,
    series: Series = DAILY,
    horizon: int = LABEL_HORIZON,
    scale: float = THRESHOLD_SCALE,
    max_span_days: int = MAX_SPAN_DAYS,
) -> DataFrame:
    """Add the label columns; rows that cannot be labeled are kept with a null label."""
    keep = df.columns
    df, series = numbered(df, series)
    df = with_forward_return(df, series, horizon, max_span_days)
    df = with_trailing_return(df, series, horizon, max_span_days)
    df = with_threshold(df, series, horizon, scale)
    labeled = F.col("forward_return").isNotNull() & F.col("threshold").isNotNull()
    return df.select(
        *[c for c in keep if c not in LABEL_COLUMNS],
        "forward_return",
        "label_end_date",
        "trailing_return",
        "threshold",
        F.when(labeled, rating_of("forward_return", "threshold")).alias("label"),
    )


def build_metrics_dataset(
    prices: DataFrame,
    series: Series = DAILY,
    max_span_days: int = MAX_SPAN_DAYS,
    max_daily_move: float = MAX_DAILY_MOVE,
    lookback_rows: int = BAD_PRICE_LOOKBACK,
    rows_per_bucket: int | None = BOUNDED,
) -> DataFrame:
    """Indicators, labels and market indicators of every complete row away from bad prices.

    A table of finer grain than a day names a ``series`` that is not bounded, and ``rows_per_bucket``.
    Rows are dropped last, so all of a date's rows count in its market indicators.
    """
    # A symbol too long for one task is cut; then the narrow steps first, and every window orders
    # by the same position columns.
    parts, ordered = split_series(prices, series)
    df, ordered = numbered(parts, ordered)
    df = label_stock(df, ordered, max_span_days=max_span_days)
    df = flag_bad_prices(df, ordered, max_daily_move, lookback_rows)
    df = compute_stock_indicators(df, series=ordered)
    # Written once: the cross-section reads a few of its columns, the result all of them.
    df = staged(to_float32(home_rows(df).drop(*ordered.positions), INDICATOR_NAMES), "indicators")
    df = compute_market_indicators(df, rows_per_bucket)
    df = to_float32(df, MARKET_INDICATOR_NAMES)
    return drop_incomplete_rows(df)


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    """Drop the flagged rows, then any row with a missing value."""
    return df.where(~F.col("near_bad_price")).drop("near_bad_price").dropna("any")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each class: rows / (classes x rows of the class). One row per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    total = single_row(totals)
    return counts.select(label, "n", (total["total"] / (total["classes"] * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)


def _days(later: Column, earlier: Column) -> Column:
    """Whole days from one timestamp to another."""
    return F.timestamp_diff("DAY", earlier, later)
