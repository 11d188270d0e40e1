"""Point-in-time news features per price row, over windows of trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import is_negative, is_positive, safe_divide, zero_fill
from quotemill.operators.asof import asof_join
from quotemill.operators.buckets import BOUNDED
from quotemill.operators.calendar import next_trading_days, trading_calendar
from quotemill.operators.joins import left_join_on_text, left_join_one_to_one
from quotemill.plans.sentiment import assert_all_scored
from quotemill.session import staged
from quotemill.schemas import (
    COUNT_FEATURES,
    HALF_LIFE_DAYS,
    LAG_DAYS,
    NEWS_HISTORY_START,
)

# The windows, as first and last age in trading days.
WINDOWS = {"1d": (0, 0), "3d": (0, 2), "before_3d": (3, 9), "7d": (0, 6)}

# What a day's articles add up to, and the windows each sum is needed over. All of them are also
# summed with the recency weight, as window "recent".
STATISTICS = {
    "articles": ["1d", "3d", "before_3d", "7d"],
    "tone": ["1d", "3d", "before_3d", "7d"],
    "tone_sq": ["7d"],
    "positive": ["1d"],
    "negative": ["1d"],
    "summaries": ["1d", "7d"],
    "summary_tone": ["1d", "7d"],
}
RECENT = ["articles", "tone", "summaries", "summary_tone"]


def scored_articles(
    news: DataFrame,
    prices: DataFrame,
    title_scores: DataFrame,
    summary_scores: DataFrame,
    history_start: str = NEWS_HISTORY_START,
) -> DataFrame:
    """Articles of priced symbols with their headline score and, where there is one, summary score."""
    recent = news.where(F.col("published_at") >= F.lit(history_start).cast("timestamp_ntz"))
    priced = recent.join(prices.select("symbol").distinct(), "symbol", "left_semi")
    with_titles = priced.join(title_scores, "title").select(
        "symbol",
        F.to_date("published_at").alias("news_day"),
        "title",
        "url",
        "lsa_summary",
        F.col("sentiment").cast("double").alias("sentiment"),
        is_positive().alias("is_positive"),
        is_negative().alias("is_negative"),
    )
    summaries = summary_scores.select(
        "lsa_summary", F.col("sentiment").cast("double").alias("summary_sentiment")
    )
    return left_join_on_text(with_titles, summaries, "lsa_summary", ["symbol", "url", "title"])


def daily_news_stats(
    articles: DataFrame, calendar: DataFrame, history_start: str, same_day: bool
) -> DataFrame:
    """Mergeable sums per symbol and the trading day its articles become available.

    Articles after the last trading day fall out.
    """
    days = next_trading_days(calendar, history_start, same_day)
    sentiment = F.col("sentiment")
    return (
        articles.join(days, "news_day")
        .groupBy("symbol", "day_idx")
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.sum(sentiment).alias("tone"),
            F.sum(sentiment * sentiment).alias("tone_sq"),
            F.count_if("is_positive").alias("positive"),
            F.count_if("is_negative").alias("negative"),
            F.count("summary_sentiment").alias("summaries"),
            F.sum("summary_sentiment").alias("summary_tone"),
        )
    )


def news_window_sums(
    daily: DataFrame, lag_days: int = LAG_DAYS, half_life: int = HALF_LIFE_DAYS
) -> DataFrame:
    """Sums over the trading-day windows, per symbol and day that has news in one of them.

    Each day's sums are copied to the ``lag_days`` days that can see them, and added up there by
    age. A window without news has a null sum.
    """
    ages = F.sequence(F.lit(0), F.lit(lag_days - 1))
    aged = daily.withColumn("_age", F.explode(ages))
    age = F.col("_age")
    weight = F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    sums = []
    for statistic, names in STATISTICS.items():
        for name in names:
            first, last = WINDOWS[name]
            inside = F.when(age.between(first, last), F.col(statistic))
            sums.append(F.sum(inside).alias(f"{statistic}_{name}"))
        if statistic in RECENT:
            sums.append(F.sum(F.col(statistic) * weight).alias(f"{statistic}_recent"))
    return aged.groupBy("symbol", (F.col("day_idx") + age).alias("day_idx")).agg(*sums)


def last_news_days(price_days: DataFrame, daily: DataFrame) -> DataFrame:
    """Add ``last_day_idx``, the latest day with news at or before each price row."""
    # Both tables have one row per symbol and day.
    return asof_join(
        price_days, daily, "day_idx", "day_idx", ["symbol"], {"last_day_idx": "day_idx"}, rows_per_bucket=BOUNDED
    )


def feature_columns() -> dict[str, Column]:
    def mean(window: str, total: str = "tone", count: str = "articles") -> Column:
        return safe_divide(f"{total}_{window}", f"{count}_{window}")

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    summary = ("summary_tone", "summaries")
    variance = safe_divide("tone_sq_7d", "articles_7d") - mean("7d") * mean("7d")
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return {
        "news_count_1d": counted("articles_1d"),
        "news_count_7d": counted("articles_7d"),
        "sentiment_mean_1d": mean("1d"),
        "sentiment_mean_7d": mean("7d"),
        "sentiment_std_7d": F.when(F.col("articles_7d") >= 2, deviation),
        "positive_ratio_1d": mean("1d", "positive"),
        "negative_count_1d": counted("negative_1d"),
        "sentiment_change_3d": mean("3d") - mean("before_3d"),
        "sentiment_ewm": mean("recent"),
        "days_since_last_news": F.col("day_idx") - F.col("last_day_idx"),
        "summary_count_7d": counted("summaries_7d"),
        "summary_sentiment_mean_1d": mean("1d", *summary),
        "summary_sentiment_mean_7d": mean("7d", *summary),
        "summary_sentiment_ewm": mean("recent", *summary),
    }


def news_features(
    prices: DataFrame,
    news: DataFrame,
    title_scores: DataFrame,
    summary_scores: DataFrame,
    same_day: bool = False,
    history_start: str = NEWS_HISTORY_START,
    check_scores: bool = True,
) -> DataFrame:
    """One row per price row from ``history_start`` with its headline and summary features.

    A row only sees articles dated before it (with ``same_day``, up to its own date). Windows count
    trading days of the market, so gaps in a symbol's prices do not stretch them.
    """
    if check_scores:
        assert_all_scored(news, title_scores)
    calendar = trading_calendar(prices, history_start)
    articles = scored_articles(news, prices, title_scores, summary_scores, history_start)
    # One row per symbol and day with news: written once, read by the windows and the as-of join, so
    # the articles and their texts are joined once.
    daily = staged(daily_news_stats(articles, calendar, history_start, same_day), "daily-news")
    windows = news_window_sums(daily)
    price_days = prices.select("symbol", "date").join(calendar, "date")
    rows = last_news_days(price_days, daily).join(windows, ["symbol", "day_idx"], "left")
    return rows.select(
        "symbol", "date", *[c.cast("float").alias(n) for n, c in feature_columns().items()]
    )


def fuse_prices_news(metrics: DataFrame, features: DataFrame, validate: bool = True) -> DataFrame:
    """The metrics rows with their news features; counts are 0 without news."""
    return zero_fill(
        left_join_one_to_one(metrics, features, ["symbol", "date"], validate), COUNT_FEATURES
    )
