"""As-of joins without a range condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.buckets import BOUNDED, ROWS_PER_BUCKET, in_ranges


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str],
    values: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add to each left row the ``values`` of the nearest right row of its group, null if none.

    ``backward`` takes the latest right row at or before the left row, ``forward`` the earliest at
    or after it; ``strict`` excludes equal times. Right rows that share a time are told apart by
    their values, the largest is taken. ``values`` maps output names to right columns.

    A left row with a null time or a null in its group keys has no answer, as in an equi-join.

    Both sides are stacked and ordered once by time. A group with many rows is cut into time
    ranges, and a range without a right row before some left row takes the nearest row of the
    ranges before it, so no task orders a whole hot group. Groups bounded by definition (daily
    tables: one row per day) are ordered whole with ``rows_per_bucket=BOUNDED``.
    """
    by = list(by)
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    backward = direction == "backward"
    names = left.columns

    hits = right.dropna(subset=[right_on, *by]).select(
        *by,
        F.col(right_on).alias("_time"),
        F.struct(*[F.col(source).alias(name) for name, source in values.items()]).alias("_hit"),
    )
    rows = left.select(*by, F.col(left_on).alias("_time"), F.struct(*names).alias("_row"))
    # Side order at one time: rights come before lefts if equal times match, after them if not.
    right_side = 1 if strict else 0
    events = rows.select(
        *by,
        "_time",
        "_row",
        F.lit(None).cast(hits.schema["_hit"].dataType).alias("_hit"),
        F.lit(1 - right_side).alias("_side"),
    ).unionByName(
        hits.select(
            *by,
            "_time",
            F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
            "_hit",
            F.lit(right_side).alias("_side"),
        )
    )
    time_order = F.col("_time").asc() if backward else F.col("_time").desc()
    order = [time_order, F.col("_side").asc(), F.col("_hit").asc_nulls_first()]

    if rows_per_bucket is BOUNDED:
        found = _last_hit(events, by, order).where(F.col("_row").isNotNull())
        known = F.col("_time").isNotNull()
        for key in by:
            known = known & F.col(key).isNotNull()
        found = found.withColumn("_found", F.when(known, F.col("_found")))
    else:
        found = _last_hit_in_ranges(events, by, order, backward, rows_per_bucket)
    return found.select(
        *[F.col("_row")[c].alias(c) for c in names],
        *[F.col("_found")[name].alias(name) for name in values],
    )


def _last_hit(events: DataFrame, group: list[str], order) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_found", F.last("_hit", True).over(window))


def _last_hit_in_ranges(
    events: DataFrame, by: list[str], order, backward: bool, rows_per_bucket: int
) -> DataFrame:
    # Only one right row per time can be an answer; it is found map-side.
    hits = (
        events.where(F.col("_hit").isNotNull())
        .groupBy(*by, "_time", "_side")
        .agg(F.max("_hit").alias("_hit"))
    )
    # One row per left time, so that a time shared by many left rows is ordered once.
    asked = (
        events.where(F.col("_row").isNotNull() & F.col("_time").isNotNull())
        .select(*by, "_time", "_side")
        .distinct()
        .withColumn("_hit", F.lit(None).cast(hits.schema["_hit"].dataType))
    )
    bucketed = in_ranges(asked.unionByName(hits), by, "_time", rows_per_bucket)
    pick = F.max_by if backward else F.min_by
    ends = bucketed.groupBy(*by, "_bucket").agg(
        pick(F.col("_hit"), F.when(F.col("_hit").isNotNull(), F.col("_time"))).alias("_end")
    )
    chain = F.col("_bucket").asc() if backward else F.col("_bucket").desc()
    before = Window.partitionBy(*by).orderBy(chain).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", True).over(before)).drop("_end")
    answers = (
        _last_hit(bucketed, [*by, "_bucket"], order)
        .where(F.col("_hit").isNull())
        .join(carried, [*by, "_bucket"])
        .select(*by, "_time", F.coalesce("_found", "_carried").alias("_found"))
    )
    return events.where(F.col("_row").isNotNull()).join(answers, [*by, "_time"], "left")
