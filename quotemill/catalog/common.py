"""Inputs the registered queries share, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.catalog.base import HISTORY_START, MAX_ARTICLES, MAX_MOVE
from quotemill.functions.scalars import safe_divide
from quotemill.plans import indicators, labels, news, news_features
from quotemill.session import staged
from quotemill.sources import testbed


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.prices(spark, sf_dir)


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.normalize_news(testbed.raw_articles(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.clean_news(raw_news(spark, sf_dir), MAX_ARTICLES)


def scored_news(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean news, and the scores of their titles and summaries."""
    articles = staged(clean(spark, sf_dir), "news")
    return (
        articles,
        testbed.title_scores(articles, "title"),
        testbed.title_scores(articles, "lsa_summary"),
    )


def daily_news(spark: SparkSession, sf_dir: str, same_day: bool = False):
    """Prices, their calendar, and the daily news sums."""
    table = staged(prices(spark, sf_dir), "prices")
    articles, titles, summaries = scored_news(spark, sf_dir)
    days = news_features.trading_calendar(table, HISTORY_START)
    scored = news_features.scored_articles(articles, table, titles, summaries, HISTORY_START)
    daily = news_features.daily_news_stats(scored, days, HISTORY_START, same_day)
    return table, days, staged(daily, "daily-news")


def features(spark: SparkSession, sf_dir: str, same_day: bool = False, table: DataFrame | None = None) -> DataFrame:
    table = staged(prices(spark, sf_dir), "prices") if table is None else table
    articles, titles, summaries = scored_news(spark, sf_dir)
    return news_features.news_features(table, articles, titles, summaries, same_day, HISTORY_START)


def metrics(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    table = staged(prices(spark, sf_dir), "prices") if table is None else table
    return labels.build_metrics_dataset(table, max_daily_move=MAX_MOVE)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_stock(prices(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled rows with probabilities that follow the momentum, stored for repeated scans."""
    panel = indicators.compute_stock_indicators(
        prices(spark, sf_dir), ["momentum_14d", "volatility_21d"]
    )
    panel = labels.label_stock(panel).dropna(
        "any", subset=["label", "trailing_return", "momentum_14d", "volatility_21d"]
    )
    z = F.coalesce(safe_divide("momentum_14d", "threshold"), F.lit(0.0))
    panel = panel.withColumn("_z", z).withColumns(
        {
            "p_up": 1 / (1 + F.exp(1 - F.col("_z"))) / 2,
            "p_down": 1 / (1 + F.exp(1 + F.col("_z"))) / 2,
        }
    )
    day = F.unix_date(F.to_date("date"))
    return staged(
        panel.select(
            "symbol", "date", "label", "label_end_date", "trailing_return", "threshold",
            "forward_return", "close", "volume", "volatility_21d", "momentum_14d",
            "p_down", "p_up",
            (1 - F.col("p_up") - F.col("p_down")).alias("p_hold"),
            (day % 3 != 0).cast("bigint").alias("news_count_7d"),
        ),
        "predictions",
    )
