"""When news is priced in: sentiment against market-adjusted returns around the article's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import safe_divide
from quotemill.operators.buckets import BOUNDED, group_medians
from quotemill.operators.series import DAILY, Series
from quotemill.plans.evaluation import mean_ics, rank_ic
from quotemill.schemas import MIN_ROWS_PER_DATE
from quotemill.session import staged

# The windows, all relative to the trading day A the article falls on.
WINDOWS = ["same_day", "overnight", "next_day"]


def window_returns(prices: DataFrame, series: Series = DAILY) -> DataFrame:
    """Per price row: close A-1 to close A, close A to open A+1, open A+1 to close A+1."""
    close, opening = F.col("adj_close"), series.lead("adj_open")
    return prices.select(
        "symbol",
        "date",
        (safe_divide(close, series.lag("adj_close")) - 1).alias("same_day"),
        (safe_divide(opening, close) - 1).alias("overnight"),
        (safe_divide(series.lead("adj_close"), opening) - 1).alias("next_day"),
    )


def news_window_ics(
    prices: DataFrame,
    calendar: DataFrame,
    daily: DataFrame,
    min_rows: int = MIN_ROWS_PER_DATE,
    rows_per_bucket: int | None = BOUNDED,
) -> DataFrame:
    """Per window: mean rank correlation of a day's mean sentiment with the excess return, and t-stat.

    ``daily`` has the news sums by symbol and the trading day of the article itself.
    """
    returns = staged(window_returns(prices), "window-returns")
    market = group_medians(returns, ["date"], {f"_market_{w}": w for w in WINDOWS}, rows_per_bucket)
    tone = daily.select("symbol", "day_idx", safe_divide("tone", "articles").alias("tone"))
    # The calendar and the market have one row per date.
    rows = (
        returns.join(calendar, "date")
        .join(market, "date")
        .join(tone, ["symbol", "day_idx"])
    )
    items = [
        F.struct(F.lit(w).alias("window"), (F.col(w) - F.col(f"_market_{w}")).alias("excess"))
        for w in WINDOWS
    ]
    stacked = rows.select("date", "tone", F.explode(F.array(*items)).alias("_item")).select(
        "date", "tone", "_item.window", "_item.excess"
    )
    ics = rank_ic(
        stacked.where(F.col("excess").isNotNull()), "tone", "excess", ["date", "window"], min_rows, rows_per_bucket
    )
    return mean_ics(ics, "window")
