"""Indicators across the symbols of each date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.buckets import BOUNDED, group_medians, with_average_ranks

# Which indicators get a market median, and which a rank.
MEDIANS = {"market_return_1d": "return_1d", "market_return_5d": "return_5d"}
RANKS = {"momentum_14d_rank": "momentum_14d", "relative_volume_21d_rank": "relative_volume_21d"}


def compute_market_indicators(df: DataFrame, rows_per_bucket: int | None = BOUNDED) -> DataFrame:
    """Add the market medians, the excess returns and the percentile ranks to an indicator table.

    ``df`` should be a stored table: it is read once for the medians and once for the rows. A date
    has at most one row per symbol; tables of finer grain name ``rows_per_bucket``.
    """
    medians = group_medians(df, ["date"], MEDIANS, rows_per_bucket)
    # One row per date; the planner broadcasts it if it is small.
    out = df.join(medians, "date", "left").withColumns(
        {
            "excess_return_1d": F.col("return_1d") - F.col("market_return_1d"),
            "excess_return_5d": F.col("return_5d") - F.col("market_return_5d"),
        }
    )
    return with_average_ranks(out, ["date"], RANKS, pct=True, rows_per_bucket=rows_per_bucket)
