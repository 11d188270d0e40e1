"""Files, messages, streams and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import common, sql
from quotemill.catalog.base import MIN_ROWS, comparable, query, rounded, select
from quotemill.plans import evaluation, experiments, modeling, news, news_features, nyse, splits
from quotemill.schemas import ARTICLE_SCHEMA
from quotemill.session import staged, work_path
from quotemill.sources import articles, csv_files, testbed
from quotemill.streaming import messages, ticks

# --- CSV sources -------------------------------------------------------------------------------


@query(
    "scan_price_csv",
    select(sql.PRICES, "prices", ["symbol", "date", "volume"], ["close", "adj_close", "adj_open", "adj_high", "adj_low"]),
)
def _(spark, sf):
    # One folder of files per symbol, in lower case; half of them list the columns in another order.
    bars = testbed.raw_bars(spark, sf).withColumn("symbol", F.lower("symbol"))
    bars = bars.withColumnRenamed("adj_close", "adj close")
    columns = ["date", "volume", "open", "high", "low", "close", "adj close"]
    drifted = ["date", "adj close", "close", "open", "high", "low", "volume"]
    path = work_path(spark, "price-csv")
    odd = F.substring("symbol", -1, 1).cast("int") % 2 == 1
    for name, names, rows in (("even", columns, ~odd), ("odd", drifted, odd)):
        part = bars.where(rows).select("symbol", *names).repartition("symbol")
        part.write.option("header", True).partitionBy("symbol").csv(f"{path}/{name}")
    # Columns are found by the header of each file; nothing is said about them.
    df = csv_files.scan_price_csv(spark, [f"{path}/even/symbol=*", f"{path}/odd/symbol=*"], csv_files.SYMBOL_FOLDER)
    return comparable(df, "symbol", "date", "volume", "close", "adj_close", "adj_open", "adj_high", "adj_low")


# Every 97th line lacks its last columns. Every 13th title holds a comma, a quote and a line break.
BODY = "CASE WHEN i % 13 = 0 THEN Article_title || ', \"said\" and' || chr(10) || 'more' ELSE Article_title END"
NUMBERED = f"{sql.RAW_ARTICLES}, numbered AS (SELECT *, replace(Url, 'http://e/', '')::BIGINT AS i FROM raw_articles)"


def _news_files(spark, sf, breaks: bool) -> str:
    raw = testbed.raw_articles(spark, sf)
    i = F.substring_index("Url", "/", -1).cast("bigint")
    tail = F.lit(", \"said\" and\nmore") if breaks else F.lit(", \"said\" and more")
    title = F.when(i % 13 == 0, F.concat("Article_title", tail)).otherwise(F.col("Article_title"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    fields = [F.col("Date"), quoted(title), F.col("Stock_symbol"), F.col("Url"), quoted(F.coalesce("Lsa_summary", F.lit("")))]
    whole = F.concat_ws(",", *fields)
    line = F.when(i % 97 == 0, F.concat_ws(",", *fields[:2])).otherwise(whole)
    path = work_path(spark, "news-csv")
    raw.select(line.alias("value")).write.text(path)
    return path


def _scan_news(spark, path, multi_line):
    # The files are written without a header line.
    return csv_files.scan_news_csv(spark, path, multi_line=multi_line, header=False)


@query(
    "scan_news_csv",
    f"WITH {NUMBERED} SELECT upper(trim(Stock_symbol)) AS symbol, CASE WHEN Date NOT LIKE 'bad%' THEN left(Date, 19)::TIMESTAMP END AS published_at, "
    f"CASE WHEN trim({BODY}) <> '' THEN trim({BODY}) END AS title, Url AS url, Lsa_summary AS lsa_summary, Date AS raw_date "
    "FROM numbered WHERE i % 97 != 0",
)
def _(spark, sf):
    scanned = _scan_news(spark, _news_files(spark, sf, True), True)
    rows, _rejects = csv_files.split_news(scanned)
    return news.normalize_news(rows)


@query(
    "news_csv_rejects",
    f"WITH {NUMBERED} SELECT Date || ',\"' || replace({BODY.replace(' || chr(10) || ', " || ' ' || ")}, '\"', '\"\"') || '\"' AS line "
    "FROM numbered WHERE i % 97 = 0",
)
def _(spark, sf):
    scanned = _scan_news(spark, _news_files(spark, sf, False), False)
    _rows, rejects = csv_files.split_news(scanned)
    return rejects


@query(
    "scan_csv_infer",
    f"WITH {sql.BARS} SELECT symbol, date AS timestamp, round(close, 6) + 0.0 AS close, volume FROM raw_bars",
)
def _(spark, sf):
    path = work_path(spark, "nyse-csv")
    bars = testbed.raw_bars(spark, sf).select("symbol", F.col("date").alias("timestamp"), "close", "volume")
    bars.repartition("symbol").write.option("header", True).partitionBy("symbol").csv(path)
    df = csv_files.scan_csv_infer(spark, f"{path}/symbol=*", csv_files.SYMBOL_FOLDER)
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return comparable(nyse.clean_bars(df), "symbol", "timestamp", "close", "volume")


# --- Articles and messages ---------------------------------------------------------------------

PAGE_COUNT = "(SELECT count(*) FROM pages)"
ARTICLES = f"""
base AS (SELECT event_id AS id, event_type AS headline, props AS summary, html AS content, 'wire' AS source,
    CASE WHEN event_id % 4 != 0 THEN 'http://e/' || event_id END AS url, 'user ' || (user_id % 10) AS author,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'N' || (user_id % 25) END AS symbol, ts AS created_at
    FROM events JOIN pages ON page_id = event_id % {PAGE_COUNT}),
delivered AS (SELECT *, created_at AS updated_at FROM base
    UNION ALL SELECT *, created_at + INTERVAL 1 HOUR FROM base WHERE id % 10 = 0)"""


def _wall(column: str):
    """A timestamp as its UTC wall-clock time."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def _articles(spark, sf):
    return testbed.live_articles(spark, sf)


def _end(spark, sf):
    return testbed.table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("end")).first()["end"]


@query(
    "backfill_articles",
    f"WITH {ARTICLES}, e AS (SELECT max(ts) AS stop FROM events) SELECT id, symbol, created_at, updated_at, "
    "((epoch_us(created_at) - epoch_us(stop - INTERVAL 7 DAY)) // 86400000000)::BIGINT AS day_slice FROM delivered, e "
    "WHERE created_at >= stop - INTERVAL 7 DAY AND created_at < stop AND symbol IN ('N1', 'N2', 'N3')",
)
def _(spark, sf):
    stored = _articles(spark, sf)
    found = articles.backfill_articles(stored, F.lit(_end(spark, sf)), ["N1", "N2", "N3"])
    return articles.oldest_first(found).select(
        "id", F.get("symbols", F.lit(0)).alias("symbol"), _wall("created_at"), _wall("updated_at"), "day_slice"
    )


CLEANED = "clean_pages AS (SELECT page_id, {0} AS cleaned FROM pages)"


def _cleaned() -> str:
    from quotemill.catalog.news_queries import _strip_markdown, _strip_tags, _tidy, _unescape

    return CLEANED.format(_tidy(_strip_markdown(_unescape(_strip_tags("html")))))


MESSAGE_SQL = (
    f"WITH {ARTICLES}, {_cleaned()} SELECT id, headline, summary, md5(cleaned) AS content_md5, source, url, author, symbol, "
    f"created_at, updated_at FROM delivered JOIN clean_pages ON page_id = id % {PAGE_COUNT}"
)


def _message_rows(df):
    return df.select(
        "id", "headline", "summary", F.md5("content").alias("content_md5"), "source", "url", "author",
        F.get("symbols", F.lit(0)).alias("symbol"), _wall("created_at"), _wall("updated_at"),
    )


@query("to_message", MESSAGE_SQL)
def _(spark, sf):
    return _message_rows(messages.to_message(_articles(spark, sf)))


@query(
    "kafka_message_sink",
    f"WITH {ARTICLES} SELECT id::VARCHAR AS key, time_bucket(INTERVAL 1 MILLISECOND, created_at) AS timestamp, headline "
    "FROM delivered",
)
def _(spark, sf):
    path = work_path(spark, "topic")
    messages.publish_batch(messages.to_envelope(messages.to_message(_articles(spark, sf))), path)
    return spark.read.parquet(path).select(
        "key", _wall("timestamp"), F.get_json_object("value", "$.headline").alias("headline")
    )


def _landed(spark, sf) -> str:
    path = work_path(spark, "articles")
    messages.land_articles(_articles(spark, sf), path)
    return path


@query("live_article_source", MESSAGE_SQL)
def _(spark, sf):
    out = work_path(spark, "messages")
    stream = messages.live_articles(spark, _landed(spark, sf))
    run = ticks.to_parquet(messages.to_message(stream), out, work_path(spark, "checkpoint"))
    run.awaitTermination()
    return _message_rows(spark.read.schema(ARTICLE_SCHEMA).parquet(out))


@query(
    "stream_news_publish",
    f"WITH {ARTICLES} SELECT id::VARCHAR AS key, time_bucket(INTERVAL 1 MILLISECOND, created_at) AS timestamp, headline "
    "FROM delivered WHERE symbol IN ('N1', 'N2', 'N3')",
)
def _(spark, sf):
    out = work_path(spark, "topic")
    run = messages.publish_stream(
        messages.live_articles(spark, _landed(spark, sf)),
        work_path(spark, "checkpoint"),
        out,
        symbols=["N1", "N2", "N3"],
        available_now=True,
    )
    run.awaitTermination()
    return spark.read.parquet(out).select(
        "key", _wall("timestamp"), F.get_json_object("value", "$.headline").alias("headline")
    )


@query("stream_news_dedupe", f"WITH {ARTICLES} SELECT id, headline FROM base")
def _(spark, sf):
    out, landed = work_path(spark, "unique"), _landed(spark, sf)
    # Several micro-batches in no order of time; what comes later than the memory is caught up.
    stream = messages.dedupe_stream(messages.live_articles(spark, landed, messages.files_per_batch(spark, landed)))
    run = ticks.to_parquet(stream.select("id", "headline"), out, work_path(spark, "checkpoint"))
    run.awaitTermination()
    published = spark.read.parquet(out)
    # The columns that the result and the choice of a version need: bodies would only be moved.
    articles = spark.read.schema(messages.ARTICLE_SCHEMA).json(landed).select("id", "headline", "updated_at")
    return published.unionByName(messages.missed_articles(articles, published).select("id", "headline"))


@query("stream_news_dedupe_lasting", f"WITH {ARTICLES} SELECT id, headline FROM base")
def _(spark, sf):
    out, landed = work_path(spark, "unique"), _landed(spark, sf)
    # The columns that the result and the choice of a version need: a state takes every column it is given.
    stream = messages.live_articles(spark, landed, messages.files_per_batch(spark, landed)).select("id", "headline", "updated_at")
    stream = messages.dedupe_lasting(stream)
    ticks.to_parquet(stream.select("id", "headline"), out, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "backfill_by_day",
    f"WITH {ARTICLES}, e AS (SELECT max(ts) AS stop FROM events) SELECT id, count(*)::BIGINT AS deliveries, "
    "max((epoch_us(created_at) - epoch_us(stop - INTERVAL 7 DAY)) // 86400000000)::BIGINT AS day_slice, "
    "time_bucket(INTERVAL 1 MILLISECOND, max(created_at)) AS created FROM delivered, e "
    "WHERE created_at >= stop - INTERVAL 7 DAY AND created_at < stop GROUP BY id",
)
def _(spark, sf):
    # Two runs: the second finds every day finished and publishes nothing again.
    stored, end, path = _articles(spark, sf), F.lit(_end(spark, sf)), work_path(spark, "historical")
    for days in (messages.BACKFILL_DAYS, 0):
        assert len(messages.backfill_by_day(stored, end, f"{path}-days", path)) == days
    records = spark.read.parquet(path)
    back = F.regexp_extract("day", "([0-9]+)d$", 1).cast("bigint")
    created = messages.creation_time(records).cast("timestamp_ntz")
    return records.groupBy(F.col("key").cast("bigint").alias("id")).agg(
        F.count("*").alias("deliveries"), (messages.BACKFILL_DAYS - F.max(back)).alias("day_slice"), F.max(created).alias("created")
    )


@query(
    "dedupe_messages_batch",
    f"WITH {ARTICLES} SELECT id, headline, updated_at FROM delivered QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1",
)
def _(spark, sf):
    latest = messages.dedupe_batch(_articles(spark, sf).drop("content"))
    return latest.select("id", "headline", _wall("updated_at"))


@query(
    "backfill_then_live",
    f"WITH {ARTICLES}, e AS (SELECT max(ts) AS stop FROM events) SELECT DISTINCT id FROM delivered, e "
    "WHERE (created_at >= stop - INTERVAL 7 DAY AND created_at < stop) OR id % 2 = 0",
)
def _(spark, sf):
    stored = _articles(spark, sf)
    landing = work_path(spark, "landing")
    messages.land_articles(stored.where(F.col("id") % 2 == 0), landing)
    history, live = work_path(spark, "historical"), work_path(spark, "live")
    run = messages.backfill_then_live(
        stored, messages.live_articles(spark, landing), F.lit(_end(spark, sf)), history, live,
        work_path(spark, "checkpoint"),
    )
    run.awaitTermination()
    both = spark.read.parquet(history).drop("day").unionByName(spark.read.parquet(live))
    return messages.dedupe_batch(messages.from_envelope(both).select("id", "updated_at")).select("id")


# --- Ticks -------------------------------------------------------------------------------------

TICKS = (
    f"WITH {sql.BARS} SELECT symbol AS id, round(close, 6) + 0.0 AS price, strftime(date, '%Y-%m-%d') AS time, "
    "volume::VARCHAR AS day_volume, round(close - open, 6) + 0.0 AS change, "
    "round((close - open) / nullif(open, 0), 6) + 0.0 AS change_percent FROM raw_bars"
)


def _tick_files(spark, sf, records_per_file: int) -> str:
    path = work_path(spark, "ticks")
    ticks.write_landing_files(testbed.ticks(spark, sf), path, records_per_file)
    return path


@query("jsonl_microbatch_sink", TICKS)
def _(spark, sf):
    path = _tick_files(spark, sf, 5_000)
    return comparable(spark.read.schema(ticks.TICK_SCHEMA).json(path))


@query("json_file_stream_source", TICKS)
def _(spark, sf):
    out = work_path(spark, "tick-table")
    stream = ticks.tick_stream(spark, _tick_files(spark, sf, 20_000))
    ticks.to_parquet(stream, out, work_path(spark, "checkpoint")).awaitTermination()
    return comparable(spark.read.parquet(out))


@query("stream_ticks", TICKS)
def _(spark, sf):
    # Two runs over a growing folder: the checkpoint makes the second one read the new files only.
    out, checkpoint, path = work_path(spark, "tick-table"), work_path(spark, "checkpoint"), work_path(spark, "ticks")
    rows = testbed.ticks(spark, sf)
    for early in (F.col("time") < "1998", F.col("time") >= "1998"):
        ticks.write_landing_files(rows.where(early), path, 20_000)
        ticks.to_parquet(ticks.tick_stream(spark, path), out, checkpoint).awaitTermination()
    return comparable(spark.read.parquet(out))


@query("stream_parquet_sink", "SELECT event_id, value + 1 AS result FROM events")
def _(spark, sf):
    out = work_path(spark, "projected")
    ticks.to_parquet(_event_stream(spark, sf), out, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "result")


def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return ticks.project_result(stream.select("event_id", "value"))


@query("stream_projection", "SELECT event_id, value + 1 AS result FROM events")
def _(spark, sf):
    out = work_path(spark, "projected")
    run = _event_stream(spark, sf).writeStream.trigger(availableNow=True).option(
        "checkpointLocation", work_path(spark, "checkpoint")
    )
    run.foreachBatch(lambda df, _batch: df.write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "result")


# --- Model jobs --------------------------------------------------------------------------------

MODEL_FEATURES = ["return_5d", "sma_20", "volatility_21d", "momentum_14d", "relative_volume_21d"]


def _model_rows(spark, sf):
    """Labeled rows with a few features and their split, stored for the repeated fits."""
    from quotemill.plans import indicators, labels

    panel = indicators.compute_stock_indicators(common.prices(spark, sf), MODEL_FEATURES)
    panel = labels.label_stock(panel).dropna("any", subset=["label", "trailing_return", *MODEL_FEATURES])
    return staged(panel, "model-rows")


@query("fit_classifier")
def _(spark, sf):
    rows = splits.chronological_split(_model_rows(spark, sf))
    model = modeling.fit_forest(
        rows.where(F.col("split") == "train"), MODEL_FEATURES, {"n_trees": 5, "max_depth": 4}
    )
    return comparable(modeling.score_predictions(model.predict(rows.where(F.col("split") == "val"))))


@query("fit_boosted_classifier")
def _(spark, sf):
    rows = splits.chronological_split(_model_rows(spark, sf))
    model = modeling.fit_boosted(
        rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val"), MODEL_FEATURES,
        {"n_trees": 3, "max_depth": 3},
    )
    return comparable(modeling.score_predictions(model.predict(rows.where(F.col("split") == "test"))))


@query("predict_proba")
def _(spark, sf):
    rows = splits.chronological_split(_model_rows(spark, sf))
    path = work_path(spark, "model")
    fitted = modeling.fit_forest(
        rows.where(F.col("split") == "train"), MODEL_FEATURES, {"n_trees": 5, "max_depth": 4}
    )
    modeling.save_model(spark, fitted, path, {"study_name": "s", "start_date": "1995", "params": {"n_trees": 5}})
    model = modeling.load_model(spark, path)
    predicted = model.predict(rows.where(F.col("split") == "test"))
    return comparable(predicted, "symbol", "date", "label", *evaluation.PROBABILITIES)


@query("save_model_with_metadata")
def _(spark, sf):
    rows = splits.chronological_split(_model_rows(spark, sf))
    path = work_path(spark, "model")
    params = {"n_trees": 3, "max_depth": 3}
    fitted = modeling.fit_forest(rows.where(F.col("split") == "train"), MODEL_FEATURES, params)
    ranges = {r["split"]: [r["first_date"], r["last_date"]] for r in splits.split_date_ranges(rows).collect()}
    modeling.save_model(spark, fitted, path, {"study_name": "s", "start_date": "1995", "params": params, "splits": ranges})
    return spark.read.json(f"{path}/metadata")


@query("walk_forward_tune")
def _(spark, sf):
    found = modeling.walk_forward_tune(
        spark,
        _model_rows(spark, sf),
        MODEL_FEATURES,
        {"n_trees": [4], "max_depth": [2, 4], "min_rows": [20]},
        n_folds=2,
        n_finalists=2,
    )
    return comparable(found.trials)


FUSED_ALL = f"""{sql.METRICS}, {sql.SCORED_NEWS}, {sql.news_features()},
split_dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n
    FROM (SELECT DISTINCT date FROM metrics)),
split_bounds AS (SELECT max(date) FILTER (idx = floor(n * 0.72::DOUBLE)) AS train_end,
    max(date) FILTER (idx = floor(n * (0.72::DOUBLE + 0.13::DOUBLE))) AS test_start FROM split_dates),
fused AS (SELECT m.symbol, m.date, m.label, m.adx, coalesce(f.news_count_7d::FLOAT::DOUBLE, 0) AS news_count_7d,
    f.sentiment_ewm::FLOAT::DOUBLE AS sentiment_ewm,
    CASE WHEN m.date < train_end - INTERVAL 14 DAY THEN 'train'
        WHEN m.date >= train_end AND m.date < test_start - INTERVAL 14 DAY THEN 'val'
        WHEN m.date >= test_start THEN 'test' END AS split
    FROM metrics m LEFT JOIN features f ON f.symbol = m.symbol AND f.date = m.date, split_bounds)"""


def _experiment_rows(spark, sf):
    table = staged(common.prices(spark, sf), "prices")
    metrics = staged(common.metrics(spark, sf, table), "metrics")
    features = staged(common.features(spark, sf, table=table), "features")
    fresher = staged(common.features(spark, sf, True, table), "same-day")
    return experiments.load_experiment_splits(news_features.fuse_prices_news(metrics, features), fresher)


@query(
    "load_experiment_splits",
    f"WITH {FUSED_ALL} SELECT symbol, date, label, split, {rounded('adx', 'news_count_7d', 'sentiment_ewm')} "
    "FROM fused WHERE split IS NOT NULL",
)
def _(spark, sf):
    return comparable(
        _experiment_rows(spark, sf), "symbol", "date", "label", "split", "adx", "news_count_7d", "sentiment_ewm"
    )


@query("run_experiments")
def _(spark, sf):
    rows = staged(_experiment_rows(spark, sf), "experiment-rows")
    path = work_path(spark, "experiments")
    params = {"n_trees": 3, "max_depth": 3}
    tables = experiments.run_experiments(spark, rows, params, path, seeds=[0], min_rows=MIN_ROWS)
    # A second run finds every configuration saved.
    assert not experiments.run_experiment(spark, experiments.EXPERIMENTS[0], 0, rows, params, path)
    return comparable(tables["per_seed"])


@query("summarize")
def _(spark, sf):
    rows = staged(_experiment_rows(spark, sf), "experiment-rows")
    path = work_path(spark, "experiments")
    wanted = [e for e in experiments.EXPERIMENTS if e.name in ("A", "B")]
    tables = experiments.run_experiments(spark, rows, {"n_trees": 3, "max_depth": 3}, path, wanted, [0, 1], MIN_ROWS)
    return comparable(tables["seed_averaged"].join(tables["differences"], "experiment", "left"))
