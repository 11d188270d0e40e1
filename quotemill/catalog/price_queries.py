"""Price tables, window primitives, indicators, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import common, sql
from quotemill.catalog.base import MAX_MOVE, N_FOLDS, comparable, query, rounded, select
from quotemill.functions import scalars
from quotemill.operators import buckets, ewm
from quotemill.operators.series import DAILY
from quotemill.plans import indicators, labels, market, modeling, nyse, prices, splits
from quotemill.session import staged
from quotemill.sources import testbed

KEYS = ["symbol", "date"]

# --- Price table -------------------------------------------------------------------------------


@query("adjust_prices", select(sql.PRICES, "prices", KEYS, ["adj_open", "adj_high", "adj_low"]))
def _(spark, sf):
    return comparable(common.prices(spark, sf), *KEYS, "adj_open", "adj_high", "adj_low")


@query(
    "filter_positive_prices",
    select(sql.BARS, "raw_bars WHERE adj_close > 0 AND close > 0", KEYS, ["close", "adj_close"]),
)
def _(spark, sf):
    return comparable(prices.positive_prices(testbed.raw_bars(spark, sf)), *KEYS, "close", "adj_close")


@query(
    "cast_types",
    f"WITH {sql.BARS}, t AS (SELECT symbol, date::VARCHAR AS date, volume::VARCHAR AS volume, "
    "close::VARCHAR AS close FROM raw_bars) SELECT symbol, date::TIMESTAMP AS date, "
    "volume::BIGINT AS volume, round(close::DOUBLE, 6) + 0.0 AS close FROM t",
)
def _(spark, sf):
    texts = testbed.raw_bars(spark, sf)
    texts = texts.select("symbol", *[F.col(c).cast("string").alias(c) for c in prices.PRICE_TYPES])
    return comparable(prices.cast_prices(texts), *KEYS, "volume", "close")


@query(
    "downcast_float32",
    f"WITH {sql.PRICES} SELECT symbol, date, volume, round(close::FLOAT::DOUBLE, 6) + 0.0 AS close, "
    "round(adj_close, 9) + 0.0 AS adj_close FROM prices",
)
def _(spark, sf):
    df = scalars.to_float32(common.prices(spark, sf), ["volume", "close"])
    return df.select(
        *KEYS,
        "volume",
        F.round(F.col("close").cast("double"), 6).alias("close"),
        F.round("adj_close", 9).alias("adj_close"),
    )


@query("filter_start_date", select(sql.PRICES, "prices WHERE date >= TIMESTAMP '1996-01-01'", KEYS, ["close"]))
def _(spark, sf):
    return comparable(prices.from_date(common.prices(spark, sf), "1996-01-01"), *KEYS, "close")


@query(
    "safe_divide",
    f"WITH {sql.PRICES} SELECT symbol, date, round((high - low) / nullif(close - open, 0), 6) + 0.0 AS ratio FROM prices",
)
def _(spark, sf):
    ratio = scalars.safe_divide(F.col("high") - F.col("low"), F.col("close") - F.col("open"))
    return comparable(common.prices(spark, sf).select(*KEYS, ratio.alias("ratio")))


@query("sort_symbol_date", select(sql.PRICES, "prices ORDER BY symbol, date", KEYS, ["adj_close"]))
def _(spark, sf):
    return comparable(prices.sorted_by_symbol_date(common.prices(spark, sf)), *KEYS, "adj_close")


# --- Window primitives -------------------------------------------------------------------------


@query(
    "lag_lead",
    f"WITH {sql.PRICES} SELECT symbol, date, round(lag(adj_close) OVER {sql.W}, 6) + 0.0 AS lag_1, "
    f"round(lag(adj_close, 7) OVER {sql.W}, 6) + 0.0 AS lag_7, "
    f"round(lead(adj_open, 8) OVER {sql.W}, 6) + 0.0 AS lead_8 FROM prices",
)
def _(spark, sf):
    return comparable(
        common.prices(spark, sf).select(
            *KEYS,
            DAILY.lag("adj_close").alias("lag_1"),
            DAILY.lag("adj_close", 7).alias("lag_7"),
            DAILY.lead("adj_open", 8).alias("lead_8"),
        )
    )


@query(
    "rolling_mean_full",
    f"WITH {sql.PRICES} SELECT symbol, date, round({sql.rolling('avg', 'adj_close', 20)}, 9) + 0.0 AS mean_20, "
    f"round({sql.rolling('avg', 'volume', 21)}, 9) + 0.0 AS volume_21 FROM prices",
)
def _(spark, sf):
    return comparable(
        common.prices(spark, sf).select(
            *KEYS,
            DAILY.rolling_mean("adj_close", 20).alias("mean_20"),
            DAILY.rolling_mean("volume", 21).alias("volume_21"),
        ),
        digits=9,
    )


@query(
    "rolling_std_full",
    f"WITH {sql.PRICES} SELECT symbol, date, round({sql.rolling('stddev_samp', 'adj_close', 14)}, 6) + 0.0 AS std_14 FROM prices",
)
def _(spark, sf):
    df = common.prices(spark, sf).select(*KEYS, DAILY.rolling_std("adj_close", 14).alias("std_14"))
    return comparable(df)


@query(
    "rolling_partial",
    f"WITH {sql.PRICES} SELECT symbol, date, round(avg(close) OVER {sql.frame(20)}, 6) + 0.0 AS mean_20, "
    f"round(stddev_samp(close) OVER {sql.frame(14)}, 6) + 0.0 AS std_14 FROM prices",
)
def _(spark, sf):
    return comparable(
        common.prices(spark, sf).select(
            *KEYS,
            F.avg("close").over(DAILY.trailing(20)).alias("mean_20"),
            F.stddev("close").over(DAILY.trailing(14)).alias("std_14"),
        )
    )


@query(
    "rolling_max_back_fwd",
    f"WITH {sql.PRICES}, t AS (SELECT symbol, date, coalesce(adj_close / lag(adj_close) OVER {sql.W} - 1 > {MAX_MOVE}, false) "
    "AS jump FROM prices) SELECT symbol, date, max(jump) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING "
    "AND CURRENT ROW) AS jumped, max(jump) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) "
    "AS will_jump FROM t",
)
def _(spark, sf):
    jump = scalars.flag(DAILY.pct_change("adj_close") > MAX_MOVE)
    df = common.prices(spark, sf).withColumn("jump", jump)
    return df.select(
        *KEYS,
        DAILY.any_within("jump", 60, 0).alias("jumped"),
        DAILY.any_within("jump", 0, 8).alias("will_jump"),
    )


@query(
    "ewm_mean",
    f"WITH {sql.PRICES}, t AS (SELECT *, row_number() OVER {sql.W} AS rn FROM prices) "
    f"SELECT symbol, date, round({sql.ewm('adj_close', 'rn', sql.span(10))}, 6) + 0.0 AS ewm_10, "
    f"round({sql.ewm('adj_close', 'rn', sql.span(50))}, 6) + 0.0 AS ewm_50 FROM t",
)
def _(spark, sf):
    df = ewm.with_ewm(
        common.prices(spark, sf).select(*KEYS, "adj_close"),
        DAILY,
        {"ewm_10": ewm.from_span("adj_close", 10), "ewm_50": ewm.from_span("adj_close", 50)},
    )
    return comparable(df, *KEYS, "ewm_10", "ewm_50")


@query(
    "ewm_std",
    f"WITH {sql.STEPS}, {sql.labels()} SELECT symbol, date, round(threshold / 0.5 / sqrt(7), 6) + 0.0 AS ewm_std FROM lab4",
)
def _(spark, sf):
    change = F.log(F.try_divide(F.col("adj_close"), DAILY.lag("adj_close")))
    df = common.prices(spark, sf).select(*KEYS, change.alias("change"))
    return comparable(ewm.with_ewm_std(df, DAILY, "change", 21, 21, "ewm_std"), *KEYS, "ewm_std")


@query(
    "pct_change",
    f"WITH {sql.PRICES} SELECT symbol, date, round(adj_close / lag(adj_close, 5) OVER {sql.W} - 1, 6) + 0.0 AS change_5 FROM prices",
)
def _(spark, sf):
    return comparable(common.prices(spark, sf).select(*KEYS, DAILY.pct_change("adj_close", 5).alias("change_5")))


@query(
    "row_diff",
    f"WITH {sql.PRICES} SELECT symbol, date, round(adj_high - lag(adj_high) OVER {sql.W}, 6) + 0.0 AS diff FROM prices",
)
def _(spark, sf):
    return comparable(common.prices(spark, sf).select(*KEYS, DAILY.diff("adj_high").alias("diff")))


@query(
    "pct_rank_avg",
    f"WITH {sql.PRICES}, t AS (SELECT symbol, date, nullif(volume, 25) AS volume FROM prices) "
    f"SELECT symbol, date, round({sql.pct_rank('volume')}, 6) + 0.0 AS pct FROM t",
)
def _(spark, sf):
    # Volumes are whole numbers, so there are ties; one value is made missing.
    df = common.prices(spark, sf).select(*KEYS, F.nullif(F.col("volume"), F.lit(25)).alias("volume"))
    return comparable(buckets.with_pct_rank(staged(df, "volumes"), ["date"], "volume", "pct"), *KEYS, "pct")


@query(
    "quantile_bucket",
    f"WITH {sql.PRICES}, t AS (SELECT symbol, date, {sql.pct_rank('close')} AS pct FROM prices) "
    "SELECT symbol, date, greatest(least(ceil(pct * 5), 5), 1)::BIGINT AS bucket FROM t",
)
def _(spark, sf):
    df = staged(common.prices(spark, sf).select(*KEYS, "close"), "closes")
    ranked = buckets.with_pct_rank(df, ["date"], "close", "pct")
    return ranked.select(*KEYS, buckets.quantile_bucket("pct", 5).alias("bucket"))


# --- Indicators --------------------------------------------------------------------------------


def _indicator_query(key: str, *names: str) -> None:
    flags = [n for n in names if n.endswith("_cross")]
    numbers = [n for n in names if n not in flags]

    @query(key, select(sql.STEPS, "indicators", [*KEYS, *flags], numbers))
    def _(spark, sf):
        df = indicators.compute_stock_indicators(common.prices(spark, sf), names)
        return comparable(df, *KEYS, *names)


_indicator_query("returns", "return_1d", "return_5d", "return_14d")
_indicator_query("sma", "sma_20", "sma_50", "sma_200")
_indicator_query("sma_50_200_spread", "sma_50_200_spread")
_indicator_query("golden_cross", "golden_cross")
_indicator_query("death_cross", "death_cross")
_indicator_query("ema", "ema_10", "ema_20", "ema_50")
_indicator_query("volatility", "volatility_14d", "volatility_21d", "volatility_60d")
_indicator_query("momentum", "momentum_7d", "momentum_14d")
_indicator_query("rsi_14d", "rsi_14d")
_indicator_query("macd", "macd")
_indicator_query("macd_signal", "macd_signal")
_indicator_query("macd_histogram", "macd_histogram")
_indicator_query("dmi", "dmi")
_indicator_query("adx", "adx")
_indicator_query("intraday_range", "intraday_range")
_indicator_query("gap", "gap")
_indicator_query("relative_volume_21d", "relative_volume_21d")
_indicator_query("compute_stock_indicators", *indicators.INDICATORS)


@query("plus_minus_di", select(sql.STEPS, "indicators", KEYS, ["plus_di", "minus_di"]))
def _(spark, sf):
    df = indicators.directional_indicators(common.prices(spark, sf).select(*KEYS, "adj_close", "adj_high", "adj_low"))
    return comparable(df, *KEYS, "plus_di", "minus_di")


MARKET_COLUMNS = [*market.MEDIANS, "excess_return_1d", "excess_return_5d", *market.RANKS]


@query(
    "market_indicators",
    f"WITH {sql.STEPS}, {sql.market('indicators')} SELECT symbol, date, {rounded(*MARKET_COLUMNS)} FROM market",
)
def _(spark, sf):
    sources = [*market.MEDIANS.values(), *market.RANKS.values()]
    df = indicators.compute_stock_indicators(common.prices(spark, sf), sources)
    df = staged(scalars.to_float32(df, sources).select(*KEYS, *sources), "indicators")
    return comparable(market.compute_market_indicators(df), *KEYS, *MARKET_COLUMNS)


# --- Unadjusted bars by timestamp --------------------------------------------------------------

NYSE = f"{sql.BARS}, nyse AS (SELECT symbol, date AS timestamp, close, volume FROM raw_bars)"
NYSE_KEYS = ["symbol", "timestamp"]


def _nyse_bars(spark, sf):
    bars = testbed.raw_bars(spark, sf).withColumnRenamed("date", "timestamp")
    return staged(nyse.clean_bars(bars.select(*NYSE_KEYS, "close", "volume")), "nyse")


def _nframe(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY timestamp ROWS {n - 1} PRECEDING)"


NW = "(PARTITION BY symbol ORDER BY timestamp)"


@query(
    "nyse_daily_return",
    f"WITH {NYSE} SELECT symbol, timestamp, round((close - lag(close) OVER {NW}) / nullif(lag(close) OVER {NW}, 0), 6) + 0.0 "
    "AS daily_return FROM nyse",
)
def _(spark, sf):
    return comparable(nyse.daily_return(_nyse_bars(spark, sf)), *NYSE_KEYS, "daily_return")


@query(
    "nyse_moving_averages",
    f"WITH {NYSE}, t AS (SELECT *, avg(close) OVER {_nframe(20)} AS sma_20, avg(close) OVER {_nframe(50)} AS sma_50, "
    f"avg(close) OVER {_nframe(200)} AS sma_200 FROM nyse) SELECT symbol, timestamp, "
    + ", ".join(f"round({c} + 3.3e-10, 6) + 0.0 AS {c}" for c in ("sma_20", "sma_50", "sma_200"))
    + ", "
    "(round(sma_50, 9) > round(sma_200, 9))::BIGINT AS golden_cross FROM t",
)
def _(spark, sf):
    df = nyse.moving_averages(_nyse_bars(spark, sf))
    # Means of few decimals often end in a 5; a small shift keeps both engines on one side of it. The cross is
    # the operator's own: Spark sums equal frames in the same order.
    shifted = {c: F.col(c) + 3.3e-10 for c in ("sma_20", "sma_50", "sma_200")}
    return comparable(df.withColumns(shifted), *NYSE_KEYS, *shifted, "golden_cross")


@query(
    "nyse_volatility",
    f"WITH {NYSE}, t AS (SELECT *, (close - lag(close) OVER {NW}) / nullif(lag(close) OVER {NW}, 0) AS r FROM nyse) "
    f"SELECT symbol, timestamp, round(stddev_samp(r) OVER {_nframe(14)}, 6) + 0.0 AS volatility_14d, "
    f"round(stddev_samp(r) OVER {_nframe(21)}, 6) + 0.0 AS volatility_21d FROM t",
)
def _(spark, sf):
    return comparable(nyse.volatility(_nyse_bars(spark, sf)), *NYSE_KEYS, "volatility_14d", "volatility_21d")


@query(
    "nyse_momentum",
    f"WITH {NYSE} SELECT symbol, timestamp, "
    + ", ".join(
        f"round((close - lag(close, {n}) OVER {NW}) / nullif(lag(close, {n}) OVER {NW}, 0), 6) + 0.0 AS momentum_{n}d"
        for n in (7, 14)
    )
    + " FROM nyse",
)
def _(spark, sf):
    return comparable(nyse.momentum(_nyse_bars(spark, sf)), *NYSE_KEYS, "momentum_7d", "momentum_14d")


@query(
    "dropna_subset",
    f"WITH {sql.BARS}, t AS (SELECT nullif(symbol, 'N3') AS symbol, date AS timestamp, nullif(volume, 25) AS volume, close "
    "FROM raw_bars) SELECT symbol, timestamp, volume FROM t WHERE symbol IS NOT NULL AND volume IS NOT NULL "
    "AND close IS NOT NULL AND timestamp IS NOT NULL",
)
def _(spark, sf):
    df = testbed.raw_bars(spark, sf).select(
        F.nullif(F.col("symbol"), F.lit("N3")).alias("symbol"),
        F.col("date").alias("timestamp"),
        F.nullif(F.col("volume"), F.lit(25)).alias("volume"),
        "close",
    )
    return df.dropna(subset=nyse.REQUIRED).select("symbol", "timestamp", "volume")


@query(
    "drop_duplicates",
    f"WITH {sql.BARS} SELECT symbol, date AS timestamp, round(min(px), 6) + 0.0 AS px FROM trades GROUP BY ALL",
)
def _(spark, sf):
    lines = testbed.table(spark, sf, "lineitem")
    parts = testbed.table(spark, sf, "part")
    suppliers = testbed.table(spark, sf, "supplier")
    trades = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .select(
            F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"),
            F.col("l_shipdate").alias("timestamp"),
            (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("px"),
        )
    )
    return comparable(nyse.first_per_key(trades, ["symbol", "timestamp"]))


# --- Labels and data quality -------------------------------------------------------------------

LABELED = f"{sql.STEPS}, {sql.labels()}"


@query("forward_return", select(LABELED, "labeled", KEYS, ["forward_return"]))
def _(spark, sf):
    return comparable(labels.with_forward_return(common.prices(spark, sf)), *KEYS, "forward_return")


@query(
    "label_end_date",
    f"WITH {LABELED} SELECT symbol, date, label_end_date, forward_return IS NOT NULL AS in_span FROM labeled",
)
def _(spark, sf):
    df = labels.with_forward_return(common.prices(spark, sf))
    return df.select(*KEYS, "label_end_date", F.col("forward_return").isNotNull().alias("in_span"))


@query("trailing_return", select(LABELED, "labeled", KEYS, ["trailing_return"]))
def _(spark, sf):
    return comparable(labels.with_trailing_return(common.prices(spark, sf)), *KEYS, "trailing_return")


@query("label_threshold", select(LABELED, "labeled", KEYS, ["threshold"]))
def _(spark, sf):
    return comparable(labels.with_threshold(common.prices(spark, sf)), *KEYS, "threshold")


@query(
    "label_stock",
    select(LABELED, "labeled", [*KEYS, "label_end_date", "label"], ["forward_return", "trailing_return", "threshold"]),
)
def _(spark, sf):
    return comparable(
        common.labeled(spark, sf),
        *KEYS, "label_end_date", "label", "forward_return", "trailing_return", "threshold",
    )


@query(
    "conditional_label",
    f"WITH {LABELED} SELECT symbol, date, CASE WHEN trailing_return > threshold THEN 'UP' "
    "WHEN trailing_return < -threshold THEN 'DOWN' ELSE 'HOLD' END AS rating FROM labeled",
)
def _(spark, sf):
    df = common.labeled(spark, sf)
    return df.select(*KEYS, scalars.rating_of("trailing_return", "threshold").alias("rating"))


@query(
    "label_index",
    f"WITH {LABELED} SELECT symbol, date, CASE label WHEN 'DOWN' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'UP' THEN 2 END::BIGINT "
    "AS y FROM labeled WHERE label IS NOT NULL",
)
def _(spark, sf):
    return common.labeled(spark, sf).dropna(subset=["label"]).select(*KEYS, scalars.label_index().alias("y"))


@query("flag_bad_prices", select(LABELED, "labeled", [*KEYS, "near_bad_price"]))
def _(spark, sf):
    df = prices.flag_bad_prices(common.prices(spark, sf), max_daily_move=MAX_MOVE)
    return df.select(*KEYS, "near_bad_price")


@query(
    "drop_incomplete_rows",
    f"WITH {LABELED} SELECT symbol, date, label, round(trailing_return, 6) + 0.0 AS trailing_return FROM labeled "
    "WHERE NOT near_bad_price AND label IS NOT NULL AND label_end_date IS NOT NULL AND trailing_return IS NOT NULL",
)
def _(spark, sf):
    df = labels.label_stock(common.prices(spark, sf))
    df = prices.flag_bad_prices(df, max_daily_move=MAX_MOVE)
    kept = labels.drop_incomplete_rows(
        df.select(*KEYS, "label", "label_end_date", "trailing_return", "threshold", "near_bad_price")
    )
    return comparable(kept, *KEYS, "label", "trailing_return")


METRIC_COLUMNS = [
    "return_1d", "sma_200", "ema_50", "volatility_60d", "rsi_14d", "macd_histogram",
    "intraday_range", "momentum_14d_rank", "relative_volume_21d_rank", "market_return_1d",
    "excess_return_5d", "forward_return", "threshold",
]


@query(
    "build_metrics_dataset",
    f"WITH {sql.METRICS} SELECT symbol, date, label, golden_cross, {rounded(*METRIC_COLUMNS)} FROM metrics",
)
def _(spark, sf):
    return comparable(common.metrics(spark, sf), *KEYS, "label", "golden_cross", *METRIC_COLUMNS)


@query(
    "select_model_features",
    f"WITH {sql.METRICS} SELECT label, {rounded('rsi_14d', 'adx', 'excess_return_1d')}, "
    "32::BIGINT AS n_features FROM metrics",
)
def _(spark, sf):
    df = modeling.select_model_features(common.metrics(spark, sf))
    n = len(modeling.feature_names(df))
    return comparable(
        df.withColumn("n_features", F.lit(n)), "label", "rsi_14d", "adx", "excess_return_1d", "n_features"
    )


@query(
    "prepare_model_features",
    f"WITH {sql.METRICS} SELECT {rounded('return_14d')}, golden_cross::INT::DOUBLE AS golden_cross, "
    "CASE label WHEN 'DOWN' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'UP' THEN 2 END::BIGINT AS y FROM metrics",
)
def _(spark, sf):
    df = modeling.prepare_model_features(common.metrics(spark, sf))
    return comparable(df, "return_14d", "golden_cross", "y")


@query(
    "class_weights",
    f"WITH {LABELED}, c AS (SELECT label, count(*) AS n FROM labeled WHERE label IS NOT NULL GROUP BY label) "
    "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) + 0.0 AS weight FROM c",
)
def _(spark, sf):
    return comparable(labels.class_weights(common.labeled(spark, sf)))


# --- Splits ------------------------------------------------------------------------------------

SPLITS = f"""{LABELED},
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n
    FROM (SELECT DISTINCT date FROM labeled WHERE label IS NOT NULL)),
bounds AS (SELECT max(date) FILTER (idx = floor(n * 0.72::DOUBLE)) AS train_end,
    max(date) FILTER (idx = floor(n * (0.72::DOUBLE + 0.13::DOUBLE))) AS test_start FROM dates),
splits AS (SELECT l.*, CASE WHEN date < train_end - INTERVAL 14 DAY THEN 'train'
    WHEN date >= train_end AND date < test_start - INTERVAL 14 DAY THEN 'val'
    WHEN date >= test_start THEN 'test' END AS split
    FROM labeled l, bounds WHERE label IS NOT NULL),
usable AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS m
    FROM dates, bounds WHERE date < test_start - INTERVAL 14 DAY),
cuts AS (SELECT i, CASE WHEN i = {N_FOLDS} THEN max(m) ELSE
    floor(i * ((max(m) - floor(max(m) * 0.5)) / {N_FOLDS}.0::DOUBLE) + floor(max(m) * 0.5)) END::BIGINT AS at
    FROM usable, range({N_FOLDS} + 1) t(i) GROUP BY i),
folds AS (SELECT a.i AS fold, s.date AS val_start, e.date AS val_end
    FROM cuts a JOIN cuts b ON b.i = a.i + 1 JOIN usable s ON s.idx = a.at JOIN usable e ON e.idx = b.at - 1),
fold_rows AS (SELECT fold, CASE WHEN date < val_start - INTERVAL 14 DAY THEN 'train' ELSE 'val' END AS role, l.*
    FROM labeled l JOIN folds ON date < val_start - INTERVAL 14 DAY OR date BETWEEN val_start AND val_end
    WHERE label IS NOT NULL)"""


def _labeled_rows(spark, sf):
    return staged(
        common.labeled(spark, sf).where(F.col("label").isNotNull()).select(*KEYS, "label", "label_end_date"),
        "labeled",
    )


@query("chronological_split", f"WITH {SPLITS} SELECT symbol, date, split FROM splits WHERE split IS NOT NULL")
def _(spark, sf):
    return splits.chronological_split(_labeled_rows(spark, sf)).select(*KEYS, "split")


@query("walk_forward_splits", f"WITH {SPLITS} SELECT fold, role, symbol, date FROM fold_rows")
def _(spark, sf):
    return splits.walk_forward_splits(_labeled_rows(spark, sf), N_FOLDS).select("fold", "role", *KEYS)


@query(
    "split_date_ranges",
    f"WITH {SPLITS} SELECT split, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date "
    "FROM splits WHERE split IS NOT NULL GROUP BY split",
)
def _(spark, sf):
    return splits.split_date_ranges(splits.chronological_split(_labeled_rows(spark, sf)))


@query(
    "leakage_check",
    f"WITH {SPLITS} SELECT fold, max(label_end_date) FILTER (role = 'train') AS last_train_label, "
    "min(date) FILTER (role = 'val') AS first_val, max(date) FILTER (role = 'val') AS last_val, "
    "max(label_end_date) FILTER (role = 'train') < min(date) FILTER (role = 'val') AS train_is_clean, "
    "max(date) FILTER (role = 'val') < any_value(test_start) AS test_is_clean FROM fold_rows, bounds GROUP BY fold",
)
def _(spark, sf):
    rows = _labeled_rows(spark, sf)
    folds = splits.walk_forward_splits(rows, N_FOLDS)
    splits.assert_no_leakage(folds, splits.split_bounds(rows))
    return splits.leakage_report(folds, splits.split_bounds(rows))


@query(
    "sample_symbols",
    f"WITH {sql.PRICES}, s AS (SELECT DISTINCT symbol FROM prices), placed AS (SELECT symbol, count(*) OVER () AS n, "
    "row_number() OVER (ORDER BY ('0x' || md5('0:' || symbol)[1:15])::BIGINT, symbol) AS place FROM s) "
    "SELECT symbol, date, round(close, 6) + 0.0 AS close FROM prices JOIN placed USING (symbol) "
    "WHERE place <= greatest(1, round_even(n * 0.3::DOUBLE, 0))",
)
def _(spark, sf):
    df = staged(common.prices(spark, sf).select(*KEYS, "close"), "closes")
    return comparable(splits.sample_symbols(df, 0.3, seed=0))


@query(
    "sample_symbols_size",
    f"WITH {sql.PRICES} SELECT greatest(1, round_even(count(DISTINCT symbol) * 0.3::DOUBLE, 0))::BIGINT AS n_symbols FROM prices",
)
def _(spark, sf):
    df = staged(common.prices(spark, sf).select(*KEYS, "close"), "closes")
    return splits.sample_symbols(df, 0.3, seed=0).agg(F.countDistinct("symbol").alias("n_symbols"))


@query(
    "isin_filter",
    f"WITH {sql.PRICES}, firsts AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM prices)) "
    "SELECT symbol, date, round(close, 6) + 0.0 AS close FROM prices WHERE date IN (SELECT date FROM firsts WHERE i % 8 = 0)",
)
def _(spark, sf):
    from quotemill.plans.evaluation import independent_dates

    df = staged(common.prices(spark, sf).select(*KEYS, "close"), "closes")
    chosen = independent_dates(df.select("date").distinct())
    return comparable(df.join(chosen, "date", "left_semi"), *KEYS, "close")


@query(
    "distinct",
    f"WITH {sql.PRICES} SELECT DISTINCT date FROM prices",
)
def _(spark, sf):
    return common.prices(spark, sf).select("date").distinct()
