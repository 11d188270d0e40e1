"""A decision policy and what it earns: thresholds to positions, net returns, drawdown, turnover.

A policy buys above one threshold of the expected return and sells below another, but only what it holds, so a
position depends on all decisions before it. The last decision that is not to hold says what is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.series import DAILY, Series

# Trading days of a year; names of the decisions.
DAYS_PER_YEAR = 252
BUY, SELL, HOLD = "BUY", "SELL", "HOLD"


def with_actions(df: DataFrame, expected: str, buy: float, sell: float, series: Series = DAILY) -> DataFrame:
    """Add ``action`` and ``position`` (1 or 0 after it) to a table of one row per symbol and day.

    A null expectation is no reason to act. Selling without a position is holding. The thresholds must leave room
    between them.
    """
    if sell > buy:
        raise ValueError(f"a policy cannot sell below {sell} and buy above {buy}")
    wanted = F.when(F.col(expected) > buy, 1).when(F.col(expected) < sell, 0)
    order = Window.partitionBy(*series.by).orderBy(series.order)
    decided = df.withColumn("_wanted", wanted)
    held = F.coalesce(F.last("_wanted", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    decided = decided.withColumn("_held", held)
    action = F.when(F.col("_wanted") == 1, BUY).when((F.col("_wanted") == 0) & (F.col("_held") == 1), SELL).otherwise(HOLD)
    position = F.coalesce("_wanted", "_held").cast("bigint")
    return decided.select(*df.columns, action.alias("action"), position.alias("position"))


def with_weights(df: DataFrame, close: str = "close", series: Series = DAILY) -> DataFrame:
    """Add ``weight``, ``traded`` and ``next_return`` to positions.

    Each day's money is split evenly among the positions. ``traded`` is the change of the weight since the symbol's row
    before, ``next_return`` the simple return to its next row; a symbol's last row earns nothing.
    """
    day = Window.partitionBy(series.order)
    weight = F.try_divide(F.col("position"), F.sum("position").over(day))
    weighted = df.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    order = Window.partitionBy(*series.by).orderBy(series.order)
    before = F.coalesce(F.lag("weight").over(order), F.lit(0.0))
    change = F.try_divide(F.lead(close).over(order), F.col(close)) - 1
    return weighted.withColumns({"traded": F.abs(F.col("weight") - before), "next_return": F.coalesce(change, F.lit(0.0))})


def daily_returns(weighted: DataFrame, cost: float, date: str = "date") -> DataFrame:
    """One row per day: gross and net return of the policy, turnover, exposure, and the return of holding everything.

    ``cost`` is paid on every traded share of the money.
    """
    turnover = F.sum("traded")
    return weighted.groupBy(date).agg(
        F.sum(F.col("weight") * F.col("next_return")).alias("gross_return"),
        (F.sum(F.col("weight") * F.col("next_return")) - F.lit(cost) * turnover).alias("net_return"),
        turnover.alias("turnover"),
        F.sum("weight").alias("exposure"),
        F.sum("position").alias("n_positions"),
        F.avg("next_return").alias("market_return"),
    )


def with_equity(daily: DataFrame, returns: str = "net_return", date: str = "date") -> DataFrame:
    """Add ``equity``, what 1 has become by the end of each day, and ``drawdown`` from its highest so far.

    The table has one row per day, so it is bounded by the calendar and ordered whole. A loss of everything stays one.
    """
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col(returns) <= -1).cast("int")).over(so_far) == 1
    grown = F.exp(F.sum(F.when(F.col(returns) > -1, F.log1p(returns))).over(so_far))
    out = daily.withColumn("equity", F.when(lost, F.lit(0.0)).otherwise(grown))
    highest = F.greatest(F.max("equity").over(so_far), F.lit(1.0))
    return out.withColumn("drawdown", 1 - F.col("equity") / highest)


def summary(daily: DataFrame, date: str = "date") -> DataFrame:
    """One row over a table :func:`with_equity`: yearly Sharpe ratio, total return, deepest drawdown, and means."""

    def sharpe(column: str) -> Column:
        return F.try_divide(F.avg(column), F.stddev_samp(column)) * F.sqrt(F.lit(float(DAYS_PER_YEAR)))

    return daily.agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.max_by("equity", date) - 1).alias("total_return"),
        sharpe("net_return").alias("sharpe"),
        sharpe("market_return").alias("market_sharpe"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"),
        F.avg("exposure").alias("exposure"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("winning_days"),
    )


def run_policy(df: DataFrame, expected: str, buy: float, sell: float, cost: float, series: Series = DAILY) -> DataFrame:
    """Daily results of the policy over a table with ``close``, with equity and drawdown."""
    acted = with_actions(df, expected, buy, sell, series)
    return with_equity(daily_returns(with_weights(acted, series=series), cost, series.order), date=series.order)
