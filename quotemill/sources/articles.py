"""The article store: back-filling the last days, in day slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days to back-fill, and the symbol that stands for all news.
BACKFILL_DAYS = 7
ALL_SYMBOLS = "*"


def matches_symbols(symbols: Sequence[str], column: str = "symbols") -> Column:
    """Whether an article is about one of the symbols; the wildcard matches every article."""
    if ALL_SYMBOLS in symbols:
        return F.lit(True)
    return F.coalesce(
        F.arrays_overlap(F.col(column), F.array(*[F.lit(s) for s in symbols])), F.lit(False)
    )


def backfill_articles(
    articles: DataFrame,
    end,
    symbols: Sequence[str] = (ALL_SYMBOLS,),
    backfill_days: int = BACKFILL_DAYS,
) -> DataFrame:
    """Articles of the ``backfill_days`` days before ``end``, with the day slice they fall in.

    ``end`` is a timestamp column or literal. Articles without a body are kept. Slices are counted
    from the oldest day; write them with :func:`oldest_first`.
    """
    end = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(backfill_days))
    created = F.col("created_at")
    in_range = (created >= start) & (created < end)
    slice_of = F.timestamp_diff("DAY", start, created)
    return articles.where(in_range & matches_symbols(symbols)).withColumn("day_slice", slice_of)


def oldest_first(articles: DataFrame) -> DataFrame:
    """Range partitions by creation time, each in order: the oldest files come first."""
    return articles.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id")
