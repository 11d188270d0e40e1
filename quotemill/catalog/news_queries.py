"""Articles, text functions, scoring, joins, news features and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import common, sql
from quotemill.catalog.base import HISTORY_START, MAX_ARTICLES, comparable, query, rounded, select
from quotemill.functions import scalars, text
from quotemill.operators import asof, joins
from quotemill.operators.calendar import next_trading_days, trading_calendar
from quotemill.plans import evaluation, news, news_features, sentiment
from quotemill.schemas import COUNT_FEATURES, HEADLINE_FEATURES, SUMMARY_FEATURES
from quotemill.session import staged, work_path
from quotemill.sources import tables, testbed

ARTICLE = ["symbol", "published_at", "title", "url", "lsa_summary"]

# --- Cleaning ----------------------------------------------------------------------------------


@query("normalize_news", select(sql.RAW_NEWS, "raw_news", [*ARTICLE, "raw_date"]))
def _(spark, sf):
    return common.raw_news(spark, sf)


@query("filter_valid_articles", select(sql.RAW_NEWS, f"raw_news WHERE {sql.VALID}", ARTICLE))
def _(spark, sf):
    return news.valid_articles(common.raw_news(spark, sf)).select(*ARTICLE)


@query("dedupe_first", select(sql.DEDUPED, "deduped", ARTICLE))
def _(spark, sf):
    return news.dedupe_articles(news.valid_articles(common.raw_news(spark, sf)))


@query(
    "partition_count_filter",
    f"WITH {sql.RAW_NEWS}, valid AS (SELECT * FROM raw_news WHERE {sql.VALID}) {sql.quiet_days('valid')}",
)
def _(spark, sf):
    valid = news.valid_articles(common.raw_news(spark, sf)).select(*ARTICLE)
    return news.drop_flooded_days(valid, MAX_ARTICLES)


@query("clean_news", select(sql.NEWS, "news", ARTICLE))
def _(spark, sf):
    return common.clean(spark, sf)


# --- Text --------------------------------------------------------------------------------------

OPEN_TAGS = "(a|p|strong|em|b|i|u|h[1-6]|ul|ol|li|div|span|blockquote|code|pre|img|figure)[^>]*"
CLOSE_TAGS = "/(a|p|strong|em|b|i|u|h[1-6]|ul|ol|li|div|span|blockquote|code|pre|figure)"


def _replace(expression: str, pattern: str, replacement: str, flags: str = "g") -> str:
    return f"regexp_replace({expression}, '{pattern}', '{replacement}', '{flags}')"


def _strip_tags(column: str) -> str:
    no_scripts = _replace(f"coalesce({column}, '')", "(?is)<script\\b[^>]*>.*?</script>", " ")
    return _replace(no_scripts, f"(?i)<({OPEN_TAGS}|{CLOSE_TAGS}|(br|hr)\\s*/?)>", " ")


def _unescape(expression: str) -> str:
    # The entities of the pages; their names also count without the semicolon.
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        expression = _replace(expression, f"&{name};?", character)
    return expression


def _strip_markdown(expression: str) -> str:
    for pattern, replacement in [
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"\*{1,3}([^*]+)\*{1,3}", r"\1"),
        (r"_{1,3}([^_]+)_{1,3}", r"\1"),
        (r"~~([^~]+)~~", r"\1"),
        (r"`{1,3}([^`]+)`{1,3}", r"\1"),
        (r"(?m)^>\s+", ""),
        (r"(?m)^[-*+]\s+", ""),
        (r"(?m)^\d+\.\s+", ""),
        (r"(?m)^\s*[-*_]{3,}\s*$", ""),
        (r"(?m)^(\s*\|.*\|\s*)$", ""),
    ]:
        expression = _replace(expression, pattern, replacement)
    return expression


def _tidy(expression: str) -> str:
    expression = _replace(expression, r"[ \t]+", " ")
    expression = _replace(expression, r"\n{3,}", r"\n\n").replace(r"'\n\n'", r"E'\n\n'")
    return _replace(expression, r"^\s+|\s+$", "")


@query("strip_html", f"SELECT page_id, {_unescape(_strip_tags('html'))} AS text FROM pages")
def _(spark, sf):
    return testbed.table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("text"))


@query("strip_markdown", f"SELECT doc_id, {_strip_markdown('text')} AS plain FROM documents")
def _(spark, sf):
    return testbed.table(spark, sf, "documents").select("doc_id", text.strip_markdown("text").alias("plain"))


@query(
    "clean_text",
    f"SELECT page_id, {_tidy(_strip_markdown(_unescape(_strip_tags('html'))))} AS html FROM pages",
)
def _(spark, sf):
    pages = testbed.table(spark, sf, "pages").select("page_id", "html")
    return text.clean_article_text(pages, ["html"])


# --- Scoring -----------------------------------------------------------------------------------


@query(
    "score_texts",
    f"WITH {sql.scores('documents', 'text', 'scored')} SELECT md5(text) AS text_md5, "
    f"{rounded('p_positive', 'p_negative', 'p_neutral', 'sentiment')} FROM scored",
)
def _(spark, sf):
    documents = testbed.table(spark, sf, "documents").select("text").distinct()
    scored = sentiment.lexicon_scores(documents, "text")
    return comparable(
        scored.withColumn("text_md5", F.md5("text")),
        "text_md5", "p_positive", "p_negative", "p_neutral", "sentiment",
    )


@query(
    "score_texts_batched",
    "SELECT md5(text) AS text_md5, round(least(length(text), 1000) / 1000.0, 6) + 0.0 AS p_positive "
    "FROM (SELECT DISTINCT text FROM documents)",
)
def _(spark, sf):
    def load_scorer():
        def score(texts):
            shares = [min(len(t), 1000) / 1000.0 for t in texts]
            return [(share, 0.0, 1.0 - share) for share in shares]

        return score

    documents = testbed.table(spark, sf, "documents").select("text").distinct()
    scored = sentiment.score_texts(documents, "text", load_scorer)
    return comparable(scored.withColumn("text_md5", F.md5("text")), "text_md5", "p_positive")


@query(
    "sentiment_polarity",
    f"WITH {sql.NEWS}, {sql.scores('news', 'title', 'title_scores')} SELECT title, {rounded('sentiment')}, "
    "p_positive > greatest(p_negative, p_neutral) AS is_positive, p_negative > greatest(p_positive, p_neutral) AS is_negative "
    "FROM title_scores",
)
def _(spark, sf):
    scores = testbed.title_scores(common.clean(spark, sf))
    return comparable(
        scores.select(
            "title",
            scalars.polarity().alias("sentiment"),
            scalars.is_positive().alias("is_positive"),
            scalars.is_negative().alias("is_negative"),
        )
    )


SCORED_ONCE = "SELECT DISTINCT title FROM news WHERE title IS NOT NULL AND title != 'signup'"


@query("distinct_unscored_texts", f"WITH {sql.NEWS} SELECT DISTINCT title FROM news WHERE title = 'signup'")
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    scored = testbed.title_scores(articles.where(F.col("title") != "signup"))
    return sentiment.unscored_texts(articles, scored, "title")


@query(
    "anti_join_unscored",
    f"WITH {sql.NEWS}, done AS (SELECT DISTINCT lsa_summary FROM news WHERE length(lsa_summary) % 2 = 0) "
    "SELECT DISTINCT n.lsa_summary FROM news n ANTI JOIN done USING (lsa_summary) WHERE n.lsa_summary IS NOT NULL",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    done = articles.where(F.length("lsa_summary") % 2 == 0)
    return joins.missing_keys(articles, done, "lsa_summary")


@query(
    "score_news_incremental",
    f"WITH {sql.NEWS}, {sql.scores('news', 'lsa_summary', 's')} SELECT lsa_summary, {rounded('sentiment')} FROM s",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    cache = work_path(spark, "scores")
    # The first run sees a part of the news; the second scores only what is new.
    early = articles.where(F.col("published_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    sentiment.score_new_texts(spark, early, cache, "lsa_summary")
    return comparable(
        sentiment.score_new_texts(spark, articles, cache, "lsa_summary"), "lsa_summary", "sentiment"
    )


@query(
    "compact_scores",
    f"WITH {sql.NEWS}, {sql.scores('news', 'lsa_summary', 's')} SELECT lsa_summary, {rounded('sentiment')} FROM s",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    scores = testbed.title_scores(articles, "lsa_summary")
    cached = F.length("lsa_summary") % 2 == 0
    chunks = [scores.where(cached), scores.where(~cached).select(*reversed(scores.columns))]
    merged = sentiment.compact_scores(spark, chunks, work_path(spark, "compacted"), "lsa_summary")
    return comparable(merged, "lsa_summary", "sentiment")


@query(
    "assert_all_scored",
    f"WITH {sql.NEWS} SELECT count(DISTINCT title) AS unscored FROM news WHERE title = 'signup'",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    sentiment.assert_all_scored(articles, testbed.title_scores(articles))
    scored = testbed.title_scores(articles.where(F.col("title") != "signup"))
    return sentiment.unscored_texts(articles, scored, "title").agg(F.count(F.lit(1)).alias("unscored"))


# --- Joins -------------------------------------------------------------------------------------


@query(
    "join_title_scores",
    f"WITH {sql.SCORED_NEWS} SELECT symbol, url, title, {rounded('sentiment')} FROM news JOIN title_scores USING (title)",
)
def _(spark, sf):
    articles, titles, _summaries = common.scored_news(spark, sf)
    return comparable(articles.join(titles, "title"), "symbol", "url", "title", "sentiment")


@query(
    "join_summary_scores",
    f"WITH {sql.SCORED_NEWS} SELECT symbol, url, lsa_summary, {rounded('sentiment')} "
    "FROM news LEFT JOIN summary_scores USING (lsa_summary)",
)
def _(spark, sf):
    articles, _titles, summaries = common.scored_news(spark, sf)
    joined = joins.left_join_on_text(articles, summaries, "lsa_summary", ["symbol", "url"])
    return comparable(joined, "symbol", "url", "lsa_summary", "sentiment")


# Symbols traded more than the mean symbol.
PRICED = (
    "SELECT symbol FROM prices GROUP BY symbol "
    "HAVING sum(volume) * (SELECT count(DISTINCT symbol) FROM prices) > (SELECT sum(volume) FROM prices)"
)


@query(
    "semi_join_symbols",
    f"WITH {sql.PRICES}, {sql.NEWS} SELECT symbol, url, published_at FROM news WHERE symbol IN ({PRICED})",
)
def _(spark, sf):
    traded = staged(common.prices(spark, sf).groupBy("symbol").agg(F.sum("volume").alias("volume")), "traded")
    mean = traded.agg((F.sum("volume") / F.count(F.lit(1))).alias("volume")).scalar()
    priced = traded.where(F.col("volume") > mean).select("symbol")
    return common.clean(spark, sf).join(priced, "symbol", "left_semi").select("symbol", "url", "published_at")


CALENDAR = (
    "calendar AS (SELECT date, rank() OVER (ORDER BY date) AS day_idx FROM "
    f"(SELECT date FROM prices WHERE date >= TIMESTAMP '{HISTORY_START}' GROUP BY date))"
)


@query("trading_calendar", f"WITH {sql.PRICES}, {CALENDAR} SELECT date, day_idx FROM calendar")
def _(spark, sf):
    return trading_calendar(common.prices(spark, sf), HISTORY_START)


def _asof_next(operator: str) -> str:
    return (
        f"WITH {sql.PRICES}, {sql.NEWS}, {CALENDAR}, dated AS (SELECT *, published_at::DATE::TIMESTAMP AS d FROM news "
        f"WHERE published_at >= TIMESTAMP '{HISTORY_START}') "
        f"SELECT symbol, url, day_idx FROM dated ASOF JOIN calendar ON calendar.date {operator} dated.d"
    )


def _next_day(spark, sf, same_day):
    calendar = trading_calendar(common.prices(spark, sf), HISTORY_START)
    days = next_trading_days(calendar, HISTORY_START, same_day)
    articles = common.clean(spark, sf).where(
        F.col("published_at") >= F.lit(HISTORY_START).cast("timestamp_ntz")
    )
    dated = articles.withColumn("news_day", F.to_date("published_at"))
    return dated.join(days, "news_day").select("symbol", "url", "day_idx")


@query("asof_join_next_trading_day", _asof_next(">"))
def _(spark, sf):
    return _next_day(spark, sf, False)


@query("asof_join_next_trading_day_same_day", _asof_next(">="))
def _(spark, sf):
    return _next_day(spark, sf, True)


@query(
    "asof_join_last_news",
    f"WITH {sql.FEATURES} SELECT symbol, date, last_day_idx::DOUBLE AS last_day_idx FROM latest",
)
def _(spark, sf):
    table, calendar, daily = common.daily_news(spark, sf)
    price_days = table.select("symbol", "date").join(calendar, "date")
    found = news_features.last_news_days(price_days, daily)
    return found.select("symbol", "date", F.col("last_day_idx").cast("double").alias("last_day_idx"))


@query(
    "asof_join_general",
    f"WITH {sql.PRICES}, {sql.NEWS}, n AS (SELECT symbol, published_at, max(url) AS url FROM news GROUP BY ALL) "
    "SELECT p.symbol, p.date, n.url FROM prices p ASOF LEFT JOIN n ON n.symbol = p.symbol AND n.published_at < p.date",
)
def _(spark, sf):
    table = staged(common.prices(spark, sf).select("symbol", "date"), "prices")
    articles = staged(common.clean(spark, sf), "news")
    return asof.asof_join(
        table, articles, "date", "published_at", ["symbol"], {"url": "url"}, strict=True
    ).select("symbol", "date", "url")


@query(
    "asof_join_resolved_label",
    f"WITH {sql.STEPS}, {sql.labels()}, r AS (SELECT symbol, label_end_date, label FROM labeled WHERE label_end_date IS NOT NULL) "
    "SELECT l.symbol, l.date, r.label AS lagged_label FROM labeled l ASOF LEFT JOIN r "
    "ON r.symbol = l.symbol AND r.label_end_date <= l.date",
)
def _(spark, sf):
    return evaluation.resolved_label_lag(common.labeled(spark, sf)).select("symbol", "date", "lagged_label")


@query(
    "cross_join_lags",
    f"WITH {sql.FEATURES} SELECT symbol, day_idx, unnest(range(30)) AS lag, day_idx + unnest(range(30)) AS counted_on FROM daily",
)
def _(spark, sf):
    _table, _calendar, daily = common.daily_news(spark, sf)
    lagged = daily.withColumn("lag", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))))
    return lagged.select("symbol", "day_idx", "lag", (F.col("day_idx") + F.col("lag")).alias("counted_on"))


@query(
    "range_source",
    f"WITH {sql.FEATURES}, counted AS (SELECT day_idx, count(*) AS n FROM told GROUP BY day_idx) "
    "SELECT i AS day_idx, coalesce(n, 0) AS n FROM range(1, (SELECT count(*) FROM trading) + 1) AS r(i) "
    "LEFT JOIN counted ON counted.day_idx = i",
)
def _(spark, sf):
    # Every trading day by number, also those without news.
    _table, calendar, daily = common.daily_news(spark, sf)
    days = spark.range(1, calendar.count() + 1).withColumnRenamed("id", "day_idx")
    counted = daily.groupBy("day_idx").agg(F.sum("articles").alias("n"))
    return days.join(counted, "day_idx", "left").select("day_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_calendar", f"WITH {sql.PRICES}, {CALENDAR} SELECT symbol, date, day_idx FROM prices JOIN calendar USING (date)")
def _(spark, sf):
    table = staged(common.prices(spark, sf).select("symbol", "date"), "prices")
    return table.join(trading_calendar(table, HISTORY_START), "date").select(
        "symbol", "date", "day_idx"
    )


WINDOW_SQL = {
    f"{statistic}_{name}": f"sum({statistic}) FILTER (age BETWEEN {news_features.WINDOWS[name][0]} AND {news_features.WINDOWS[name][1]})"
    for statistic, names in news_features.STATISTICS.items()
    for name in names
} | {f"{c}_recent": f"sum({c} * power(2.0, -age / 3.0))" for c in news_features.RECENT}
SUMMED = "summed AS (SELECT symbol, day_idx + age AS day_idx, {0} FROM aged GROUP BY ALL)".format(
    ", ".join(f"({e})::DOUBLE AS {n}" for n, e in WINDOW_SQL.items())
)
WINDOWED = f"{sql.FEATURES}, aged AS (SELECT *, unnest(range(30)) AS age FROM daily), {SUMMED}"
SOME_SUMS = ["articles_7d", "tone_7d", "articles_recent"]


@query(
    "left_join_windows",
    f"WITH {WINDOWED} SELECT symbol, date, {rounded(*SOME_SUMS)} FROM price_days LEFT JOIN summed USING (symbol, day_idx)",
)
def _(spark, sf):
    table, calendar, daily = common.daily_news(spark, sf)
    price_days = table.select("symbol", "date").join(calendar, "date")
    windows = news_features.news_window_sums(daily)
    windows = windows.withColumn("articles_7d", F.col("articles_7d").cast("double"))
    return comparable(price_days.join(windows, ["symbol", "day_idx"], "left"), "symbol", "date", *SOME_SUMS)


FUSED = f"""{sql.METRICS}, {sql.SCORED_NEWS}, {sql.news_features()},
fused AS (SELECT m.symbol, m.date, m.label, {", ".join(
    f"coalesce(f.{c}::FLOAT::DOUBLE, 0) AS {c}" if c in COUNT_FEATURES else f"f.{c}::FLOAT::DOUBLE AS {c}"
    for c in HEADLINE_FEATURES + SUMMARY_FEATURES)}
    FROM metrics m LEFT JOIN features f ON f.symbol = m.symbol AND f.date = m.date)"""


@query(
    "fuse_prices_news",
    f"WITH {FUSED} SELECT symbol, date, label, {rounded(*HEADLINE_FEATURES, *SUMMARY_FEATURES)} FROM fused",
)
def _(spark, sf):
    table = staged(common.prices(spark, sf), "prices")
    metrics = staged(common.metrics(spark, sf, table).select("symbol", "date", "label"), "metrics")
    features = staged(common.features(spark, sf, table=table), "features")
    fused = news_features.fuse_prices_news(metrics, features)
    return comparable(fused, "symbol", "date", "label", *HEADLINE_FEATURES, *SUMMARY_FEATURES)


@query(
    "zero_fill_counts",
    f"WITH {sql.FEATURES} SELECT p.symbol, p.date, coalesce(f.news_count_7d, 0)::DOUBLE AS news_count_7d, "
    "round(f.sentiment_mean_7d::FLOAT::DOUBLE, 6) + 0.0 AS sentiment_mean_7d "
    "FROM prices p LEFT JOIN features f ON f.symbol = p.symbol AND f.date = p.date",
)
def _(spark, sf):
    table = staged(common.prices(spark, sf), "prices")
    features = common.features(spark, sf, table=table).select(
        "symbol", "date", "news_count_7d", "sentiment_mean_7d"
    )
    joined = table.select("symbol", "date").join(features, ["symbol", "date"], "left")
    return comparable(scalars.zero_fill(joined, COUNT_FEATURES))


@query(
    "suffix_columns",
    f"WITH {sql.PRICES}, {sql.SCORED_NEWS}, {sql.news_features(True)} SELECT symbol, date, "
    "news_count_1d::DOUBLE AS news_count_1d_same_day, "
    "round(sentiment_ewm::FLOAT::DOUBLE, 6) + 0.0 AS sentiment_ewm_same_day FROM features",
)
def _(spark, sf):
    df = common.features(spark, sf, same_day=True).select("symbol", "date", "news_count_1d", "sentiment_ewm")
    return comparable(scalars.suffix_columns(df, ["news_count_1d", "sentiment_ewm"], "_same_day"))


@query(
    "join_per_year",
    f"WITH {sql.PRICES}, {sql.NEWS}, a AS (SELECT year(published_at) AS year, count(*) AS articles FROM news GROUP BY 1), "
    "b AS (SELECT year(date) AS year, count(DISTINCT symbol) AS price_symbols FROM prices GROUP BY 1) "
    "SELECT a.year, articles, price_symbols FROM a JOIN b ON a.year = b.year",
)
def _(spark, sf):
    articles = common.clean(spark, sf)
    per_year = articles.groupBy(F.year("published_at").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("articles")
    )
    return per_year.join(F.broadcast(news.price_symbols_per_year(common.prices(spark, sf))), "year")


# --- News features -----------------------------------------------------------------------------

COUNTS = ["articles", "positive", "negative", "summaries"]
TONES = ["tone", "tone_sq", "summary_tone"]


@query("daily_news_stats", select(sql.FEATURES, "daily", ["symbol", "day_idx", *COUNTS], TONES))
def _(spark, sf):
    _table, _calendar, daily = common.daily_news(spark, sf)
    return comparable(daily, "symbol", "day_idx", *COUNTS, *TONES)


@query("news_window_sums", select(WINDOWED, "summed", ["symbol", "day_idx"], list(WINDOW_SQL)))
def _(spark, sf):
    _table, _calendar, daily = common.daily_news(spark, sf)
    windows = news_features.news_window_sums(daily)
    doubles = {c: F.col(c).cast("double") for c in WINDOW_SQL}
    return comparable(windows.withColumns(doubles), "symbol", "day_idx", *WINDOW_SQL)


def _feature_query(key: str, *names: str, same_day: bool = False) -> None:
    columns = ", ".join(f"round({c}::FLOAT::DOUBLE, 6) + 0.0 AS {c}" for c in names)

    @query(
        key,
        f"WITH {sql.PRICES}, {sql.SCORED_NEWS}, {sql.news_features(same_day)} SELECT symbol, date, {columns} FROM features",
    )
    def _(spark, sf):
        return comparable(common.features(spark, sf, same_day), "symbol", "date", *names)


_feature_query("news_counts", "news_count_1d", "news_count_7d", "negative_count_1d")
_feature_query("sentiment_means", "sentiment_mean_1d", "sentiment_mean_7d")
_feature_query("sentiment_std_7d", "sentiment_std_7d")
_feature_query("positive_ratio_1d", "positive_ratio_1d")
_feature_query("sentiment_change_3d", "sentiment_change_3d")
_feature_query("sentiment_ewm", "sentiment_ewm")
_feature_query("days_since_last_news", "days_since_last_news")
_feature_query("summary_features", *SUMMARY_FEATURES)
_feature_query("news_features", *HEADLINE_FEATURES, *SUMMARY_FEATURES)
_feature_query("news_features_same_day", *HEADLINE_FEATURES, *SUMMARY_FEATURES, same_day=True)


# --- Profiles ----------------------------------------------------------------------------------


@query(
    "profile_parsing",
    f"WITH {sql.NEWS} SELECT count(*) AS rows, count(*) - count(published_at) AS bad_date, "
    "count(*) - count(nullif(symbol, '')) AS no_symbol, count(*) - count(title) AS no_title, "
    "count(*) - count(lsa_summary) AS no_summary, (SELECT count(*) FROM news) AS clean_rows FROM raw_news",
)
def _(spark, sf):
    raw = staged(common.raw_news(spark, sf), "raw-news")
    return news.profile_parsing(raw, news.clean_news(raw, MAX_ARTICLES))


@query(
    "profile_bad_dates",
    f"WITH {sql.RAW_NEWS} SELECT raw_date, count(*) AS n FROM raw_news WHERE published_at IS NULL "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, sf):
    return news.profile_bad_dates(common.raw_news(spark, sf))


@query("profile_date_range", f"WITH {sql.NEWS} SELECT min(published_at) AS first, max(published_at) AS last FROM news")
def _(spark, sf):
    return news.profile_date_range(common.clean(spark, sf))


@query(
    "profile_midnight_share",
    f"WITH {sql.NEWS}, m AS (SELECT (published_at = date_trunc('day', published_at))::INT AS at_midnight FROM news) "
    "SELECT sum(at_midnight)::BIGINT AS midnight, round(100 * avg(at_midnight), 2) AS pct FROM m",
)
def _(spark, sf):
    return news.profile_midnight_share(common.clean(spark, sf))


@query(
    "profile_hour_histogram",
    f"WITH {sql.NEWS}, timed AS (SELECT (published_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM news "
    "WHERE published_at <> date_trunc('day', published_at)) SELECT extract(hour FROM local) AS hour_et, count(*) AS n "
    "FROM timed GROUP BY ALL",
)
def _(spark, sf):
    return news.profile_hour_histogram(common.clean(spark, sf))


MATCHED = "matched AS (SELECT n.*, n.symbol IN (SELECT symbol FROM prices) AS has_prices FROM news n)"


@query(
    "profile_symbol_overlap",
    f"WITH {sql.PRICES}, {sql.NEWS}, {MATCHED} SELECT count(DISTINCT symbol) AS news_symbols, "
    "count(DISTINCT CASE WHEN has_prices THEN symbol END) AS matched_symbols, "
    "(SELECT count(DISTINCT symbol) FROM prices) AS price_symbols, round(100 * avg(has_prices::INT), 2) AS pct_rows_matched "
    "FROM matched",
)
def _(spark, sf):
    return news.profile_symbol_overlap(common.clean(spark, sf), common.prices(spark, sf).select("symbol"))


@query(
    "profile_yearly_coverage",
    f"WITH {sql.PRICES}, {sql.NEWS}, {MATCHED}, "
    "told AS (SELECT year(published_at) AS year, symbol, count(*) AS n FROM matched WHERE has_prices GROUP BY ALL), "
    "traded AS (SELECT year(date) AS year, count(DISTINCT symbol) AS price_symbols FROM prices GROUP BY ALL) "
    "SELECT told.year, sum(n)::BIGINT AS articles, count(*) AS symbols_with_news, max(price_symbols) AS price_symbols, "
    "round(100 * count(*) / max(price_symbols), 1) AS pct_symbols_covered, quantile_cont(n, 0.5) AS median_per_symbol "
    "FROM told JOIN traded ON traded.year = told.year GROUP BY told.year",
)
def _(spark, sf):
    prices = staged(common.prices(spark, sf).select("symbol", "date"), "prices")
    return news.profile_yearly_coverage(staged(common.clean(spark, sf), "news"), prices)


@query(
    "profile_top_symbols",
    f"WITH {sql.NEWS} SELECT symbol, count(*) AS n FROM news GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, sf):
    return news.profile_top_symbols(common.clean(spark, sf))


# --- Set operations and limits -----------------------------------------------------------------


@query(
    "union_all",
    f"WITH {sql.NEWS} SELECT title AS text FROM news UNION ALL SELECT lsa_summary FROM news WHERE lsa_summary IS NOT NULL",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    return articles.select(F.col("title").alias("text")).union(
        articles.select("lsa_summary").where(F.col("lsa_summary").isNotNull())
    )


@query(
    "union_by_name",
    f"WITH {sql.NEWS} SELECT symbol, title, NULL AS url FROM news UNION ALL BY NAME SELECT url, symbol FROM news",
)
def _(spark, sf):
    articles = staged(common.clean(spark, sf), "news")
    return (
        articles.select("symbol", "title")
        .unionByName(articles.select("url", "symbol"), allowMissingColumns=True)
        .select("symbol", "title", "url")
    )


@query(
    "topk",
    f"WITH {sql.SCORED_NEWS} SELECT lsa_summary, {rounded('sentiment')} FROM summary_scores ORDER BY summary_scores.sentiment DESC, "
    "lsa_summary LIMIT 10",
)
def _(spark, sf):
    scores = testbed.title_scores(common.clean(spark, sf), "lsa_summary")
    return comparable(
        scores.orderBy(F.desc("sentiment"), "lsa_summary").limit(10), "lsa_summary", "sentiment"
    )


# --- Parquet sources and sinks -----------------------------------------------------------------


@query(
    "scan_parquet_pruned",
    "SELECT l_orderkey, l_shipdate AS date, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
)
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_shipdate", "date")
    return lines.where(F.col("date") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "l_orderkey", "date", "l_quantity"
    )


@query(
    "scan_file_as_table",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY event_type",
)
def _(spark, sf):
    return tables.scan_as_table(
        spark,
        f"{sf}/events.parquet",
        "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {source} GROUP BY event_type",
    )


@query("write_parquet_atomic", select(sql.PRICES, "prices", ["symbol", "date", "volume"], ["adj_close"]))
def _(spark, sf):
    path = work_path(spark, "prices")
    tables.write_parquet(common.prices(spark, sf), path)
    return comparable(tables.scan_parquet(spark, path), "symbol", "date", "volume", "adj_close")


@query(
    "load_or_build",
    select(sql.PRICES, "prices WHERE date >= TIMESTAMP '1997-01-01'", ["symbol", "date"], ["adj_close"]),
)
def _(spark, sf):
    path = work_path(spark, "prices")
    build = lambda: common.prices(spark, sf)
    tables.load_or_build(spark, path, build)

    def rebuild():
        raise AssertionError("the stored table is there")

    return comparable(
        tables.load_or_build(
            spark, path, rebuild, start_date="1997-01-01", columns=["symbol", "date", "adj_close"]
        )
    )


@query(
    "spark_parquet_overwrite",
    f"WITH {sql.BARS} SELECT symbol, date AS timestamp, volume, round(close, 6) + 0.0 AS close FROM raw_bars",
)
def _(spark, sf):
    from quotemill.plans import nyse

    path = work_path(spark, "nyse")
    bars = testbed.raw_bars(spark, sf).withColumnRenamed("date", "timestamp")
    tables.write_by_symbol(nyse.clean_bars(bars.select("symbol", "timestamp", "close", "volume")), path)
    return comparable(spark.read.parquet(path), "symbol", "timestamp", "volume", "close")
