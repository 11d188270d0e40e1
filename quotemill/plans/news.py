"""News articles: parsing rules, cleaning, and profiles of their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.buckets import group_medians
from quotemill.schemas import MAX_ARTICLES_PER_SYMBOL_DAY

# The timestamp format of the news files.
TIMESTAMP_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2} UTC$"
NEWS_COLUMNS = ["symbol", "published_at", "title", "url", "lsa_summary"]


def parse_utc(column: str) -> Column:
    """UTC wall-clock time of "2023-12-16 23:00:00 UTC", null where it does not parse."""
    text = F.col(column)
    wall_clock = F.substring_index(text, " UTC", 1).try_cast("timestamp_ntz")
    return F.when(text.rlike(TIMESTAMP_PATTERN), wall_clock)


def _blank_to_null(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def normalize_news(raw: DataFrame) -> DataFrame:
    """Raw article rows to typed columns; every row is kept."""
    return raw.select(
        F.upper(F.trim("Stock_symbol")).alias("symbol"),
        parse_utc("Date").alias("published_at"),
        _blank_to_null("Article_title").alias("title"),
        F.col("Url").alias("url"),
        _blank_to_null("Lsa_summary").alias("lsa_summary"),
        F.col("Date").alias("raw_date"),
    )


def valid_articles(news: DataFrame) -> DataFrame:
    return news.where(
        F.col("symbol").isNotNull()
        & (F.col("symbol") != "")
        & F.col("published_at").isNotNull()
        & F.col("title").isNotNull()
    )


def dedupe_articles(news: DataFrame) -> DataFrame:
    """One article per symbol, title ignoring case, and UTC day: the first in a total order.

    The first row is a minimum of a struct, so copies are combined map-side and a headline repeated
    without end never meets in one task. Nulls order last.
    """
    order = ["published_at", "url", "title", "lsa_summary"]
    fields = []
    for c in order:
        fields += [F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c)]
    first = (
        news.groupBy(
            "symbol", F.lower("title").alias("_title"), F.to_date("published_at").alias("_day")
        )
        .agg(F.min(F.struct(*fields)).alias("_first"))
    )
    return first.select("symbol", *[F.col("_first")[c].alias(c) for c in order])


def drop_flooded_days(
    news: DataFrame, max_articles: int = MAX_ARTICLES_PER_SYMBOL_DAY
) -> DataFrame:
    """Drop every article of a symbol on a UTC day with more than ``max_articles`` of them."""
    day = F.to_date("published_at")
    flooded = (
        news.groupBy("symbol", day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max_articles)
        .select("symbol", "_day")
    )
    return news.withColumn("_day", day).join(flooded, ["symbol", "_day"], "left_anti").drop("_day")


def clean_news(raw_news: DataFrame, max_articles: int = MAX_ARTICLES_PER_SYMBOL_DAY) -> DataFrame:
    """Normalized rows to clean articles: valid, without repeats, without flooded days."""
    kept = drop_flooded_days(dedupe_articles(valid_articles(raw_news)), max_articles)
    return kept.select(*NEWS_COLUMNS)


# Profiles.


def profile_parsing(raw_news: DataFrame, news: DataFrame) -> DataFrame:
    """Row counts by defect, and the clean rows."""
    clean_rows = news.agg(F.count(F.lit(1)).alias("n")).scalar()
    return raw_news.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("published_at").isNull()).alias("bad_date"),
        F.count_if(F.col("symbol").isNull() | (F.col("symbol") == "")).alias("no_symbol"),
        F.count_if(F.col("title").isNull()).alias("no_title"),
        F.count_if(F.col("lsa_summary").isNull()).alias("no_summary"),
    ).withColumn("clean_rows", clean_rows)


def profile_bad_dates(raw_news: DataFrame, n: int = 10) -> DataFrame:
    return (
        raw_news.where(F.col("published_at").isNull())
        .groupBy("raw_date")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("raw_date"))
        .limit(n)
    )


def profile_date_range(news: DataFrame) -> DataFrame:
    return news.agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"))


def _at_midnight() -> Column:
    return F.date_trunc("day", "published_at").cast("timestamp_ntz") == F.col("published_at")


def profile_midnight_share(news: DataFrame) -> DataFrame:
    """Articles at exactly 00:00 UTC, which probably only carry a date."""
    midnight = F.count_if(_at_midnight())
    return news.agg(
        midnight.alias("midnight"),
        F.round(F.try_divide(100 * midnight, F.count(F.lit(1))), 2).alias("pct"),
    )


def profile_hour_histogram(news: DataFrame) -> DataFrame:
    """Articles per New York hour, of those with a time of day."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("published_at"))
    return (
        news.where(~_at_midnight())
        .groupBy(F.hour(local).cast("bigint").alias("hour_et"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile_symbol_overlap(news: DataFrame, prices: DataFrame) -> DataFrame:
    """How many news symbols have prices, from the per-symbol counts."""
    per_symbol = news.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    priced = prices.select("symbol").distinct().withColumn("priced", F.lit(True))
    overlap = per_symbol.join(priced, "symbol", "left")
    matched = F.col("priced").isNotNull()
    return overlap.agg(
        F.count("symbol").alias("news_symbols"),
        F.count_if(matched).alias("matched_symbols"),
        F.round(
            F.try_divide(100 * F.sum(F.when(matched, F.col("n")).otherwise(0)), F.sum("n")), 2
        ).alias("pct_rows_matched"),
    ).withColumn("price_symbols", priced.agg(F.count(F.lit(1)).alias("n")).scalar())


def price_symbols_per_year(prices: DataFrame) -> DataFrame:
    """How many symbols have prices in each year; one row per year."""
    return (
        prices.select(F.year("date").cast("bigint").alias("year"), "symbol")
        .distinct()
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("price_symbols"))
    )


def profile_yearly_coverage(news: DataFrame, prices: DataFrame) -> DataFrame:
    """Per year, for symbols with prices: articles, symbols covered, median per symbol."""
    priced = prices.select("symbol").distinct()
    per_symbol = (
        news.join(priced, "symbol", "left_semi")
        .groupBy(F.year("published_at").cast("bigint").alias("year"), "symbol")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = per_symbol.groupBy("year").agg(
        F.sum("n").alias("articles"), F.count(F.lit(1)).alias("symbols_with_news")
    )
    medians = group_medians(per_symbol, ["year"], {"median_per_symbol": "n"})
    # All three have one row per year.
    return (
        totals.join(F.broadcast(price_symbols_per_year(prices)), "year")
        .join(F.broadcast(medians), "year")
        .withColumn(
            "pct_symbols_covered",
            F.round(100 * F.col("symbols_with_news") / F.col("price_symbols"), 1),
        )
    )


def profile_top_symbols(news: DataFrame, n: int = 10) -> DataFrame:
    return (
        news.groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "symbol")
        .limit(n)
    )
