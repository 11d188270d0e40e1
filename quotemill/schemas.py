"""Fixed schemas, enumerations and parameters of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Class names, in class-index order.
RATINGS = ["DOWN", "HOLD", "UP"]
RATING_INDEX = {"DOWN": 0, "HOLD": 1, "UP": 2}

# Price indicators, in output order.
INDICATOR_NAMES = [
    "return_1d",
    "return_5d",
    "return_14d",
    "sma_20",
    "sma_50",
    "sma_200",
    "sma_50_200_spread",
    "golden_cross",
    "death_cross",
    "ema_10",
    "ema_20",
    "ema_50",
    "volatility_14d",
    "volatility_21d",
    "volatility_60d",
    "momentum_7d",
    "momentum_14d",
    "rsi_14d",
    "macd",
    "macd_signal",
    "macd_histogram",
    "dmi",
    "adx",
    "intraday_range",
    "gap",
    "relative_volume_21d",
]

# Indicators across the symbols of a date.
MARKET_INDICATOR_NAMES = [
    "market_return_1d",
    "market_return_5d",
    "excess_return_1d",
    "excess_return_5d",
    "momentum_14d_rank",
    "relative_volume_21d_rank",
]

# Headline news features.
HEADLINE_FEATURES = [
    "news_count_1d",
    "news_count_7d",
    "sentiment_mean_1d",
    "sentiment_mean_7d",
    "sentiment_std_7d",
    "positive_ratio_1d",
    "negative_count_1d",
    "sentiment_change_3d",
    "sentiment_ewm",
    "days_since_last_news",
]

# Summary news features.
SUMMARY_FEATURES = [
    "summary_count_7d",
    "summary_sentiment_mean_1d",
    "summary_sentiment_mean_7d",
    "summary_sentiment_ewm",
]

# Features that are 0 rather than missing without news.
COUNT_FEATURES = ["news_count_1d", "news_count_7d", "negative_count_1d", "summary_count_7d"]

# Columns that are never model inputs (raw levels and anything looking ahead).
NON_FEATURE_COLUMNS = [
    "symbol",
    "date",
    "volume",
    "open",
    "high",
    "low",
    "close",
    "adj_close",
    "adj_open",
    "adj_high",
    "adj_low",
    "forward_return",
    "threshold",
    "label",
    "label_end_date",
    "trailing_return",
]

PRICE_FEATURES = INDICATOR_NAMES + MARKET_INDICATOR_NAMES

# Columns the evaluation reads next to the features.
EVALUATION_COLUMNS = [
    "symbol",
    "date",
    "label",
    "label_end_date",
    "trailing_return",
    "threshold",
    "forward_return",
    "close",
    "volume",
]

# Label horizon in rows, and the widest calendar span of one label.
LABEL_HORIZON = 7
MAX_SPAN_DAYS = 14
# Bad-price rule, first training date, flood rule, per-date minimum.
MAX_DAILY_MOVE = 1.0
BAD_PRICE_LOOKBACK = 60
START_DATE = "2010-01-01"
MAX_ARTICLES_PER_SYMBOL_DAY = 200
MIN_ROWS_PER_DATE = 50
# News history start, recency half-life and look-back in trading days.
NEWS_HISTORY_START = "2009-01-01"
HALF_LIFE_DAYS = 3
LAG_DAYS = 30

PRICE_CSV_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("volume", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj close", T.DoubleType()),
    ]
)

TICK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("price", T.DoubleType()),
        T.StructField("time", T.StringType()),
        T.StructField("day_volume", T.StringType()),
        T.StructField("change", T.DoubleType()),
        T.StructField("change_percent", T.DoubleType()),
    ]
)

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("headline", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
