"""A threshold policy on the predictions, and embeddings of the news."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import common, sql
from quotemill.catalog.base import comparable, query, rounded
from quotemill.plans import embeddings, policy
from quotemill.session import staged
from quotemill.sources.testbed import table

# Thresholds on p_up - p_down that leave both decisions some days, and 10 basis points for every trade.
BUY_ABOVE, SELL_BELOW, COST = 0.08, -0.08, 0.001

ACTIONS = f"""{sql.PREDICTIONS},
wanted AS (SELECT symbol, date, close, CASE WHEN p_up - p_down > {BUY_ABOVE} THEN 1 WHEN p_up - p_down < {SELL_BELOW} THEN 0 END AS w
    FROM predictions),
held AS (SELECT *, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM wanted),
acted AS MATERIALIZED (SELECT symbol, date, close, CASE WHEN w = 1 THEN 'BUY' WHEN w = 0 AND held = 1 THEN 'SELL' ELSE 'HOLD' END AS action,
    coalesce(w, held)::BIGINT AS position FROM held)"""

RETURNS = f"""{ACTIONS},
weighted AS (SELECT *, CASE WHEN sum(position) OVER (PARTITION BY date) > 0
    THEN position::DOUBLE / sum(position) OVER (PARTITION BY date) ELSE 0 END AS weight FROM acted),
moved AS (SELECT date, position, weight, abs(weight - coalesce(lag(weight) OVER s, 0)) AS traded, coalesce(lead(close) OVER s / close - 1, 0) AS r
    FROM weighted WINDOW s AS (PARTITION BY symbol ORDER BY date)),
daily AS (SELECT date, sum(weight * r) AS gross_return, sum(weight * r) - {COST}::DOUBLE * sum(traded) AS net_return, sum(traded) AS turnover,
    sum(weight) AS exposure, sum(position)::BIGINT AS n_positions, avg(r) AS market_return FROM moved GROUP BY date),
grown AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM daily),
equity AS MATERIALIZED (SELECT *, 1 - equity / greatest(max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1) AS drawdown FROM grown)"""

FRACTIONS = ["gross_return", "net_return", "turnover", "exposure", "market_return", "equity", "drawdown"]


def _expected(spark, sf):
    return common.predictions(spark, sf).withColumn("expected", F.col("p_up") - F.col("p_down"))


def _daily(spark, sf):
    return policy.run_policy(_expected(spark, sf), "expected", BUY_ABOVE, SELL_BELOW, COST)


@query("policy_actions", f"WITH {ACTIONS} SELECT symbol, date, action, position FROM acted")
def _(spark, sf):
    acted = policy.with_actions(_expected(spark, sf), "expected", BUY_ABOVE, SELL_BELOW)
    return comparable(acted, "symbol", "date", "action", "position")


@query("policy_returns", f"WITH {RETURNS} SELECT date, n_positions, {rounded(*FRACTIONS)} FROM equity")
def _(spark, sf):
    return comparable(_daily(spark, sf), "date", "n_positions", *FRACTIONS)


@query(
    "policy_summary",
    f"""WITH {RETURNS} SELECT count(*) AS n_days, round(arg_max(equity, date) - 1, 6) + 0.0 AS total_return,
    round(avg(net_return) / stddev_samp(net_return) * sqrt(252), 6) + 0.0 AS sharpe,
    round(avg(market_return) / stddev_samp(market_return) * sqrt(252), 6) + 0.0 AS market_sharpe,
    round(max(drawdown), 6) + 0.0 AS max_drawdown, round(avg(turnover), 6) + 0.0 AS turnover, round(avg(exposure), 6) + 0.0 AS exposure,
    round(avg((net_return > 0)::INT), 6) + 0.0 AS winning_days FROM equity""",
)
def _(spark, sf):
    return comparable(policy.summary(staged(_daily(spark, sf), "policy")))


# --- Embeddings --------------------------------------------------------------------------------

DIM, DAYS, COMPONENTS = 64, 7, 8
TRAIN_END = "1999-01-01"

# An article's vector is that of its number, as the given tables have no other link.
VECTORS = f"""{sql.NEWS},
numbered AS (SELECT symbol, published_at::DATE AS date, regexp_extract(url, '([0-9]+)$')::BIGINT AS id FROM news),
vectors AS (SELECT symbol, date, embedding FROM numbered JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)),
days AS (SELECT symbol, date, count(*) AS n, {", ".join(f"sum(embedding[{i + 1}]::DOUBLE) AS s{i}" for i in range(DIM))} FROM vectors GROUP BY ALL),
means AS (SELECT symbol, date, sum(n) OVER w AS n, {", ".join(f"sum(s{i}) OVER w / sum(n) OVER w AS m{i}" for i in range(DIM))}
    FROM days WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL {DAYS - 1} DAY PRECEDING AND CURRENT ROW))"""


def _embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
    articles = common.clean(spark, sf).select("symbol", "published_at", (number % vectors.count()).alias("vec_id"))
    return embeddings.news_embeddings(articles.join(vectors, "vec_id"), "embedding", DIM, DAYS)


@query(
    "news_embedding_means",
    f"WITH {VECTORS} SELECT symbol, date::TIMESTAMP AS date, n::BIGINT AS news_count, "
    + ", ".join(f"round(m{i}, 6) + 0.0 AS e{i}" for i in range(DIM))
    + " FROM means",
)
def _(spark, sf):
    means = _embeddings(spark, sf)
    return comparable(means.select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), "news_count", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(DIM)]))


@query("news_embedding_components")
def _(spark, sf):
    means = staged(_embeddings(spark, sf), "news-embeddings")
    return comparable(embeddings.split_projection(means, TRAIN_END, COMPONENTS))
