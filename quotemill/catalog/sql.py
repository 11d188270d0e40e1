"""SQL building blocks of the comparison queries, written independently of the Spark plans."""

from __future__ import annotations

from quotemill.catalog.base import HISTORY_START, MAX_ARTICLES, MAX_MOVE
from quotemill.plans.sentiment import NEGATIVE_WORDS, POSITIVE_WORDS

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

BARS = f"""
trades AS (
    SELECT 'N' || s_nationkey AS symbol, l_shipdate AS date, p_retailprice * (1 - l_discount) AS px,
        l_tax, {KEY}
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
),
raw_bars AS (
    SELECT symbol, date, sum(l_quantity)::BIGINT AS volume,
        first(px ORDER BY {KEY}) AS open, max(px) AS high, min(px) AS low,
        last(px ORDER BY {KEY}) AS close,
        last(px ORDER BY {KEY}) * (1 - last(l_tax ORDER BY {KEY})) AS adj_close
    FROM trades GROUP BY symbol, date
)"""

PRICES = f"""{BARS},
prices AS MATERIALIZED (
    SELECT raw_bars.*, (adj_close * open) / close AS adj_open, (adj_close * high) / close AS adj_high,
        (adj_close * low) / close AS adj_low
    FROM raw_bars WHERE least(adj_close, close) > 0
)"""

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "adj_open", "adj_high", "adj_low"]


def number(x: float) -> str:
    return f"({x!r})::DOUBLE"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def rolling(function: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) OVER {frame(n)} = {n} THEN {function}({column}) OVER {frame(n)} END"


def ewm(x: str, k: str, alpha: float) -> str:
    """Unrolled recursion over a series without inner gaps; ``k`` counts its values from 1."""
    q = number(1.0 - alpha)
    share = f"(CASE WHEN {k} = 1 THEN 1.0 ELSE {number(alpha)} END)"
    return (
        f"pow({q}, {k} - 1) * sum({share} * {x} * pow({q}, 1 - {k})) "
        "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
    )


W = "(PARTITION BY symbol ORDER BY date)"
SO_FAR = "(PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
WILDER = 1.0 / 14.0


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) OVER {W}"


STEPS = f"""{PRICES},
step1 AS (
    SELECT *, row_number() OVER {W} AS rn, {lag("adj_close")} AS prev_close,
        adj_close / {lag("adj_close")} - 1 AS r1,
        adj_close / {lag("adj_close", 5)} - 1 AS r5,
        adj_close / {lag("adj_close", 14)} - 1 AS r14,
        adj_close / nullif({lag("adj_close", 7)}, 0) - 1 AS m7,
        {rolling("avg", "adj_close", 20)} AS a20,
        {rolling("avg", "adj_close", 50)} AS a50,
        {rolling("avg", "adj_close", 200)} AS a200,
        {rolling("avg", "volume", 21)} AS v21,
        coalesce(adj_close - {lag("adj_close")}, 0) AS delta,
        adj_high - {lag("adj_high")} AS up, {lag("adj_low")} - adj_low AS down,
        greatest(adj_high - adj_low, adj_high - {lag("adj_close")}, adj_low - {lag("adj_close")}) AS tr
    FROM prices
),
step2 AS (
    SELECT *,
        coalesce(a50 > a200 AND {lag("a50")} <= {lag("a200")}, false) AS golden,
        coalesce(a50 < a200 AND {lag("a50")} >= {lag("a200")}, false) AS death,
        {rolling("stddev_samp", "r1", 14)} AS s14,
        {rolling("stddev_samp", "r1", 21)} AS s21,
        {rolling("stddev_samp", "r1", 60)} AS s60,
        CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain_1,
        CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss_1,
        CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
        CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm,
        {", ".join(f"{ewm('adj_close', 'rn', span(n))} AS e{n}" for n in (10, 12, 20, 26, 50))}
    FROM step1
),
step3 AS (
    SELECT *,
        {rolling("avg", "gain_1", 14)} AS gain_14,
        {rolling("avg", "loss_1", 14)} AS loss_14,
        {ewm("(e12 - e26)", "rn", span(9))} AS signal,
        100 * {ewm("pdm", "rn", WILDER)} / nullif({ewm("tr", "rn", WILDER)}, 0) AS pdi,
        100 * {ewm("mdm", "rn", WILDER)} / nullif({ewm("tr", "rn", WILDER)}, 0) AS mdi
    FROM step2
),
step4 AS (
    SELECT *, 100 * abs(pdi - mdi) / nullif(abs(pdi + mdi), 0) AS dmi FROM step3
),
step5 AS (
    SELECT *, count(dmi) OVER {SO_FAR} AS dmi_k FROM step4
),
indicators AS (
    SELECT symbol, date, volume, open, high, low, close, adj_close, adj_open, adj_high, adj_low,
        r1 AS return_1d, r5 AS return_5d, r14 AS return_14d,
        adj_close / nullif(a20, 0) - 1 AS sma_20, adj_close / nullif(a50, 0) - 1 AS sma_50,
        adj_close / nullif(a200, 0) - 1 AS sma_200, a50 / nullif(a200, 0) - 1 AS sma_50_200_spread,
        golden AS golden_cross, death AS death_cross,
        adj_close / e10 - 1 AS ema_10, adj_close / e20 - 1 AS ema_20, adj_close / e50 - 1 AS ema_50,
        s14 AS volatility_14d, s21 AS volatility_21d, s60 AS volatility_60d,
        m7 AS momentum_7d, r14 AS momentum_14d,
        CASE WHEN loss_14 = 0 AND gain_14 = 0 THEN NULL WHEN loss_14 = 0 THEN 100.0
            ELSE 100 - 100 / (1 + gain_14 / loss_14) END AS rsi_14d,
        (e12 - e26) / adj_close AS macd, signal / adj_close AS macd_signal,
        (e12 - e26) / adj_close - signal / adj_close AS macd_histogram,
        pdi AS plus_di, mdi AS minus_di, dmi,
        CASE WHEN dmi_k > 0 THEN {ewm("dmi", "greatest(dmi_k, 1)", WILDER)} END AS adx,
        (adj_high - adj_low) / adj_close AS intraday_range,
        (adj_open - prev_close) / nullif(prev_close, 0) AS gap,
        volume / nullif(v21, 0) AS relative_volume_21d
    FROM step5
)"""

OPENING = "CASE WHEN adj_open > 0 THEN adj_open END"


def labels(max_span_days: int = 14, move: float = MAX_MOVE) -> str:
    """Label columns and the bad-price flag over the indicator table."""
    q = 1.0 - span(21)
    a = span(21)
    w2 = f"(pow({number(q)}, 2 * (lk - 1)) + {number(a * a / (1 - q * q))} * (1 - pow({number(q)}, 2 * (lk - 1))))"
    return f"""
lab1 AS (
    SELECT *, {OPENING} AS op, ln(adj_close / {lag("adj_close")}) AS lr,
        lead(date, 8) OVER {W} AS label_end_date, lag(date, 7) OVER {W} AS start_date,
        ln(adj_close / {lag("adj_close", 7)}) AS tr7,
        coalesce(adj_close / {lag("adj_close")} - 1 > {move} OR adj_open / {lag("adj_close")} - 1 > {move}, false)
            AS bad
    FROM indicators
),
lab2 AS (
    SELECT *, count(lr) OVER {SO_FAR} AS lk,
        CASE WHEN date_diff('day', date, label_end_date) <= {max_span_days}
            THEN ln(lead(op, 8) OVER {W} / lead(op, 1) OVER {W}) END AS forward_return,
        CASE WHEN date_diff('day', start_date, date) <= {max_span_days} THEN tr7 END AS trailing_return,
        max(bad) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 8 FOLLOWING)
            AS near_bad_price
    FROM lab1
),
lab3 AS (
    SELECT *, {ewm("lr", "greatest(lk, 1)", a)} AS m1, {ewm("(lr * lr)", "greatest(lk, 1)", a)} AS m2 FROM lab2
),
lab4 AS (
    SELECT *, CASE WHEN lk >= 21
        THEN 0.5 * sqrt(greatest((m2 - m1 * m1) / (1 - {w2}), 0)) * sqrt(7) END AS threshold
    FROM lab3
),
labeled AS MATERIALIZED (
    SELECT *, CASE WHEN forward_return IS NULL OR threshold IS NULL THEN NULL
        WHEN forward_return > threshold THEN 'UP' WHEN forward_return < -threshold THEN 'DOWN'
        ELSE 'HOLD' END AS label
    FROM lab4
)"""


def pct_rank(column: str, by: str = "date") -> str:
    """Average rank of ties over the non-null count."""
    return (
        f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {column} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0) / count({column}) OVER (PARTITION BY {by}) END"
    )


MARKET_SOURCE = ["return_1d", "return_5d", "momentum_14d", "relative_volume_21d"]


def market(source: str, name: str = "market") -> str:
    """Market indicators over float32 indicators."""
    casts = ", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in MARKET_SOURCE)
    return f"""
mk1 AS (SELECT * REPLACE ({casts}) FROM {source}),
mk2 AS (SELECT date, median(return_1d) AS market_return_1d, median(return_5d) AS market_return_5d
    FROM mk1 GROUP BY date),
{name} AS MATERIALIZED (
    SELECT mk1.*, market_return_1d, market_return_5d,
        return_1d - market_return_1d AS excess_return_1d, return_5d - market_return_5d AS excess_return_5d,
        {pct_rank("momentum_14d", "mk1.date")} AS momentum_14d_rank,
        {pct_rank("relative_volume_21d", "mk1.date")} AS relative_volume_21d_rank
    FROM mk1 JOIN mk2 ON mk1.date = mk2.date
)"""


NOT_NULL = [
    "return_1d", "return_5d", "return_14d", "sma_20", "sma_50", "sma_200", "sma_50_200_spread",
    "ema_10", "ema_20", "ema_50", "volatility_14d", "volatility_21d", "volatility_60d",
    "momentum_7d", "momentum_14d", "rsi_14d", "macd", "macd_signal", "macd_histogram", "dmi", "adx",
    "intraday_range", "gap", "relative_volume_21d", "forward_return", "threshold",
    "trailing_return", "label_end_date", "label",
]

INDICATOR_COLUMNS = [c for c in NOT_NULL[:24]]
MARKET_COLUMNS = [
    "market_return_1d", "market_return_5d", "excess_return_1d", "excess_return_5d",
    "momentum_14d_rank", "relative_volume_21d_rank",
]

# Indicators are stored as float32.
METRICS = f"""{STEPS}, {labels()}, {market("labeled")},
metrics AS MATERIALIZED (
    SELECT * REPLACE ({", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in INDICATOR_COLUMNS + MARKET_COLUMNS)})
    FROM market WHERE NOT near_bad_price AND {" AND ".join(f"{c} IS NOT NULL" for c in NOT_NULL)}
)"""


def _word_count(text: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"len(list_filter(string_split_regex(lower({text}), '[^a-z]+'), lambda w: list_contains([{listed}], w)))"
    )


def scores(source: str, column: str, name: str) -> str:
    """Lexicon scores of the distinct texts of a column."""
    return f"""
{name}_words AS (
    SELECT {column}, pow(1.0 + {_word_count(column, POSITIVE_WORDS)}, 2) AS wp,
        pow(1.0 + {_word_count(column, NEGATIVE_WORDS)}, 2) AS wn
    FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)
),
{name} AS (
    SELECT *, p_positive - p_negative AS sentiment FROM (
        SELECT {column}, (wp / (wp + wn + 3))::FLOAT AS p_positive, (wn / (wp + wn + 3))::FLOAT AS p_negative,
            (3.0::DOUBLE / (wp + wn + 3))::FLOAT AS p_neutral
        FROM {name}_words)
)"""


RAW_ARTICLES = """
moved AS (
    SELECT *, TIMESTAMP '1995-01-01' + to_seconds(((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 80) // 1000000)
        AS m FROM events
),
raw_articles AS (
    SELECT
        CASE WHEN event_id % 101 = 0 THEN '  ' ELSE ' n' || (user_id % 25) || ' ' END AS Stock_symbol,
        CASE WHEN event_id % 103 = 0 THEN 'bad ' || (event_id % 3)
            ELSE strftime(CASE WHEN event_id % 7 = 0 THEN date_trunc('day', m)::TIMESTAMP ELSE m END,
                '%Y-%m-%d %H:%M:%S') || ' UTC' END AS Date,
        CASE WHEN event_id % 107 = 0 THEN ' ' WHEN event_id % 5 = 0 THEN upper(event_type)
            ELSE event_type END AS Article_title,
        'http://e/' || event_id AS Url,
        CASE WHEN event_id % 3 != 0 THEN event_type || ' ' || props END AS Lsa_summary
    FROM moved
)"""

RAW_NEWS = f"""{RAW_ARTICLES},
raw_news AS MATERIALIZED (
    SELECT trim(upper(Stock_symbol)) AS symbol,
        CASE WHEN Date LIKE '____-__-__ __:__:__ UTC' THEN left(Date, 19)::TIMESTAMP END AS published_at,
        CASE WHEN trim(Article_title) <> '' THEN trim(Article_title) END AS title, Url AS url,
        CASE WHEN trim(Lsa_summary) <> '' THEN trim(Lsa_summary) END AS lsa_summary, Date AS raw_date
    FROM raw_articles
)"""

VALID = "length(symbol) > 0 AND published_at IS NOT NULL AND title IS NOT NULL"

DEDUPED = f"""{RAW_NEWS},
deduped AS MATERIALIZED (
    SELECT DISTINCT ON (symbol, lower(title), date_trunc('day', published_at))
        symbol, published_at, title, url, lsa_summary
    FROM raw_news WHERE {VALID}
    ORDER BY symbol, lower(title), date_trunc('day', published_at), published_at, url NULLS LAST, title,
        lsa_summary NULLS LAST
)"""


def quiet_days(source: str) -> str:
    """Rows of the symbol-days without too many articles."""
    return (
        f"SELECT symbol, published_at, title, url, lsa_summary FROM {source} JOIN (SELECT symbol, published_at::DATE AS d "
        f"FROM {source} GROUP BY ALL HAVING count(*) <= {MAX_ARTICLES}) q USING (symbol) WHERE published_at::DATE = q.d"
    )


NEWS = f"""{DEDUPED},
news AS MATERIALIZED ({quiet_days("deduped")})"""

SCORED_NEWS = f"""{NEWS}, {scores("news", "title", "title_scores")}, {scores("news", "lsa_summary", "summary_scores")}"""


def news_features(same_day: bool = False) -> str:
    """Features from the definitions: each price row looks at the articles of its last 30 trading days."""
    seen = "<" if same_day else "<="

    def within(expression: str, ages: str) -> str:
        return f"CASE WHEN age {ages} THEN {expression} END"

    recency = "power(2.0, -age / 3.0)"
    return f"""
trading AS MATERIALIZED (
    SELECT date, rank() OVER (ORDER BY date) AS day_idx
    FROM (SELECT date FROM prices WHERE date >= TIMESTAMP '{HISTORY_START}' GROUP BY date)
),
told AS MATERIALIZED (
    SELECT * FROM (
        SELECT n.symbol, t.sentiment::DOUBLE AS tone,
            (t.p_positive > t.p_negative AND t.p_positive > t.p_neutral)::INT AS good,
            (t.p_negative > t.p_positive AND t.p_negative > t.p_neutral)::INT AS bad,
            s.sentiment::DOUBLE AS summary_tone,
            1 + (SELECT count(*) FROM trading c WHERE c.date {seen} n.published_at::DATE) AS day_idx
        FROM news n JOIN title_scores t ON t.title = n.title
        LEFT JOIN summary_scores s ON s.lsa_summary = n.lsa_summary
        WHERE n.published_at >= TIMESTAMP '{HISTORY_START}' AND EXISTS (SELECT 1 FROM prices p WHERE p.symbol = n.symbol)
    ) WHERE day_idx <= (SELECT max(day_idx) FROM trading)
),
daily AS MATERIALIZED (
    SELECT symbol, day_idx, count(*) AS articles, sum(tone) AS tone, sum(tone * tone) AS tone_sq,
        sum(good)::BIGINT AS positive, sum(bad)::BIGINT AS negative, count(summary_tone) AS summaries,
        sum(summary_tone) AS summary_tone
    FROM told GROUP BY symbol, day_idx
),
price_days AS MATERIALIZED (SELECT symbol, date, day_idx FROM prices JOIN trading USING (date)),
looked AS (
    SELECT p.symbol, p.date, p.day_idx, p.day_idx - a.day_idx AS age, a.* EXCLUDE (symbol, day_idx)
    FROM price_days p LEFT JOIN told a ON a.symbol = p.symbol AND a.day_idx BETWEEN p.day_idx - 29 AND p.day_idx
),
latest AS (
    SELECT p.symbol, p.date, max(d.day_idx) AS last_day_idx
    FROM price_days p LEFT JOIN daily d ON d.symbol = p.symbol AND d.day_idx <= p.day_idx GROUP BY ALL
),
features AS MATERIALIZED (
    SELECT symbol, date,
        count({within("1", "= 0")}) AS news_count_1d, count({within("1", "< 7")}) AS news_count_7d,
        avg({within("tone", "= 0")}) AS sentiment_mean_1d, avg({within("tone", "< 7")}) AS sentiment_mean_7d,
        CASE WHEN count({within("1", "< 7")}) > 1 THEN stddev_pop({within("tone", "< 7")}) END AS sentiment_std_7d,
        avg({within("good", "= 0")}) AS positive_ratio_1d,
        coalesce(sum({within("bad", "= 0")}), 0) AS negative_count_1d,
        avg({within("tone", "< 3")}) - avg({within("tone", "BETWEEN 3 AND 9")}) AS sentiment_change_3d,
        sum(tone * {recency}) / sum({recency}) AS sentiment_ewm,
        any_value(day_idx) - any_value(last_day_idx) AS days_since_last_news,
        count({within("summary_tone", "< 7")}) AS summary_count_7d,
        avg({within("summary_tone", "= 0")}) AS summary_sentiment_mean_1d,
        avg({within("summary_tone", "< 7")}) AS summary_sentiment_mean_7d,
        sum(summary_tone * {recency}) / sum(CASE WHEN summary_tone IS NOT NULL THEN {recency} END)
            AS summary_sentiment_ewm
    FROM looked JOIN latest USING (symbol, date) GROUP BY symbol, date
)"""


FEATURES = f"{PRICES}, {SCORED_NEWS}, {news_features()}"

PREDICTIONS = f"""{STEPS}, {labels()},
predictions AS MATERIALIZED (
    SELECT symbol, date, label, label_end_date, trailing_return, threshold, forward_return, close, volume,
        volatility_21d, momentum_14d, p_down, p_up, 1 - p_up - p_down AS p_hold,
        CASE label WHEN 'DOWN' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'UP' THEN 2 END::BIGINT AS y,
        (epoch(date) / 86400)::BIGINT % 3 != 0 AS has_news
    FROM (
        SELECT *, 1 / (1 + exp(1 - z)) / 2 AS p_up, 1 / (1 + exp(1 + z)) / 2 AS p_down
        FROM (SELECT *, coalesce(momentum_14d / nullif(threshold, 0), 0) AS z FROM labeled
            WHERE label IS NOT NULL AND trailing_return IS NOT NULL AND momentum_14d IS NOT NULL
                AND volatility_21d IS NOT NULL))
)"""
