"""The market calendar: the dates with prices, numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(prices: DataFrame, history_start: str | None = None) -> DataFrame:
    """Distinct price dates from ``history_start`` with a dense ``day_idx`` from 1.

    One row per date, so it is bounded by the calendar and safe to order in one task and to
    broadcast.
    """
    dates = prices.select("date")
    if history_start is not None:
        dates = dates.where(F.col("date") >= F.lit(history_start).cast("timestamp_ntz"))
    numbered = F.row_number().over(Window.orderBy("date")).cast("bigint")
    return dates.distinct().select("date", numbered.alias("day_idx"))


def next_trading_days(calendar: DataFrame, news_from: str, same_day: bool = False) -> DataFrame:
    """Every calendar day from ``news_from`` to the last trading day, with the trading day its
    news counts on.

    That is the first trading day after it, or with ``same_day`` the day itself if it is one. This
    turns the forward as-of join into an equi-join with a table of one row per calendar day, which
    is bounded by the calendar and can be broadcast.
    """
    day = F.to_date("date")
    previous = F.to_date(F.lag("date").over(Window.orderBy("date")))
    after_previous = F.date_add(previous, 1) if same_day else previous
    spans = calendar.select(
        "day_idx",
        F.coalesce(after_previous, F.lit(news_from).cast("date")).alias("_low"),
        (day if same_day else F.date_sub(day, 1)).alias("_high"),
    )
    return spans.where(F.col("_low") <= F.col("_high")).select(
        F.explode(F.sequence("_low", "_high")).alias("news_day"), "day_idx"
    )
