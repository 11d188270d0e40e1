"""Market tables derived from the star schema: bars, articles, scores, messages and ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.plans.prices import stock_prices
from quotemill.plans.sentiment import lexicon_scores

# Bytes of article bodies in a partition, before copies.
ARTICLE_BYTES = 512_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier nation from the line items, unique by (symbol, date)."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    trades = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .select(
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"),
            F.col("l_shipdate").alias("date"),
            (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("px"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
            ).alias("k"),
            "l_quantity",
            "l_tax",
        )
    )
    last = F.max_by(F.struct("px", "l_tax"), F.col("k"))
    return (
        trades.groupBy("symbol", "date")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("volume"),
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            last.alias("_last"),
        )
        .select(
            "symbol",
            "date",
            "volume",
            "open",
            "high",
            "low",
            F.col("_last.px").alias("close"),
            (F.col("_last.px") * (1 - F.col("_last.l_tax"))).alias("adj_close"),
        )
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_prices(raw_bars(spark, sf_dir))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles as read from a news file: every column text, some rows defective."""
    events = table(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'2024-01-01'"), F.col("ts")) * 80
    moved = F.expr("timestamp_ntz'1995-01-01'") + F.make_dt_interval(
        secs=F.floor(micros / 1_000_000).cast("decimal(18,6)")
    )
    i = F.col("event_id")
    # Every seventh timestamp only carries a date.
    stamp = F.when(i % 7 == 0, F.date_trunc("day", moved).cast("timestamp_ntz")).otherwise(moved)
    return events.select(
        F.when(i % 101 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" n"), (F.col("user_id") % 25).cast("string"), F.lit(" ")))
        .alias("Stock_symbol"),
        F.when(i % 103 == 0, F.concat(F.lit("bad "), (i % 3).cast("string")))
        .otherwise(F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
        .alias("Date"),
        F.when(i % 107 == 0, F.lit(" "))
        .when(i % 5 == 0, F.upper("event_type"))
        .otherwise(F.col("event_type"))
        .alias("Article_title"),
        F.concat(F.lit("http://e/"), i.cast("string")).alias("Url"),
        F.when(i % 3 != 0, F.concat("event_type", F.lit(" "), "props")).alias("Lsa_summary"),
    )


def title_scores(articles: DataFrame, column: str = "title") -> DataFrame:
    """Scores of the distinct texts of an article table."""
    return lexicon_scores(articles.select(column).where(F.col(column).isNotNull()).distinct(), column)


def live_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor-style articles, with re-delivered copies, their bodies taken from the web pages.

    The events are small next to the articles they become, so they are dealt by the bytes that come out, not by those read.
    Articles of a page stand together.
    """
    events = table(spark, sf_dir, "events")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    n_pages, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    parts = events.count() * size // max(n_pages, 1) // ARTICLE_BYTES + 1
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    narrow = events.withColumn("page_id", F.col("event_id") % F.lit(n_pages).cast("bigint")).select(
        "page_id", "event_id", "event_type", "props", "user_id", "ts"
    )
    article = narrow.repartition(parts, "page_id").join(pages.repartition(parts, "page_id").hint("merge"), "page_id")
    return article.withColumn("delivery", F.explode(again)).select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("headline"),
        F.col("props").alias("summary"),
        F.col("html").alias("content"),
        F.lit("wire").alias("source"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("http://e/"), F.col("event_id").cast("string"))).alias("url"),
        F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("author"),
        F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("N"), (F.col("user_id") % 25).cast("string"))))
        .alias("symbols"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.col("delivery"))).alias("updated_at"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per bar, in the live feed's schema."""
    bars = raw_bars(spark, sf_dir)
    return bars.select(
        F.col("symbol").alias("id"),
        F.col("close").alias("price"),
        F.date_format("date", "yyyy-MM-dd").alias("time"),
        F.col("volume").cast("string").alias("day_volume"),
        (F.col("close") - F.col("open")).alias("change"),
        F.try_divide(F.col("close") - F.col("open"), F.col("open")).alias("change_percent"),
    )
