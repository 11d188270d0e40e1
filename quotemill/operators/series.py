"""Row-ordered series: window builders, and splitting of series too long for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quotemill.operators.buckets import ROWS_PER_BUCKET, ranked_values
from quotemill.operators.joins import join_null_safe

# Rows of history and future copied to a part's edge, for windows of a fixed length. The longest has 200 rows.
# Exponential averages reach back further and are chained over the blocks of all parts instead.
HALO_BACK = 2_000
HALO_AHEAD = 16
ROWS_PER_PART = 500_000

# Rows per block of a numbered series, a power of two: smaller blocks divide it.
BLOCK_ROWS = 1_024


@dataclass(frozen=True)
class Series:
    """How a table is cut into series: the keys of a series, and its (unique) time column.

    A daily table has at most one row per symbol and day, so a series of it is bounded by the
    calendar (about 250 rows a year) and is processed whole. Series of finer grain are not
    ``bounded`` and go through :func:`split_series` first.
    """

    by: tuple[str, ...] = ("symbol",)
    order: str = "date"
    bounded: bool = True
    # Set by `numbered`: rows per block of the position columns all windows then order by.
    block_rows: int | None = None
    # Set by `split_series`: rows per part; the rows carry `_at`, their position in the whole series.
    rows_per_part: int | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        """The keys of a whole series."""
        return tuple(c for c in self.by if c != "_part")

    @property
    def positions(self) -> list[str]:
        """The columns that hold the place of a row of a numbered series."""
        return ["_block", "_at", *(["_home"] if self.rows_per_part else [])]

    def window(self) -> WindowSpec:
        order = (self.order,) if self.block_rows is None else ("_block", "_at")
        return Window.partitionBy(*self.by).orderBy(*order)

    def trailing(self, n: int) -> WindowSpec:
        return self.window().rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    # Row-wise primitives.

    def lag(self, column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.window())

    def lead(self, column, n: int = 1) -> Column:
        return F.lead(column, n).over(self.window())

    def diff(self, column: str, n: int = 1) -> Column:
        return F.col(column) - self.lag(column, n)

    def pct_change(self, column: str, n: int = 1) -> Column:
        return F.try_divide(F.col(column), self.lag(column, n)) - 1

    def rolling(self, aggregate, column, n: int) -> Column:
        """``aggregate(column)`` over ``n`` rows, null until the frame has ``n`` non-null values."""
        frame = self.trailing(n)
        return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))

    def rolling_mean(self, column, n: int) -> Column:
        return self.rolling(F.avg, column, n)

    def rolling_std(self, column, n: int) -> Column:
        return self.rolling(F.stddev_samp, column, n)

    def any_within(self, column, back: int, ahead: int) -> Column:
        """Whether a flag is set in this row, the rows before or the rows after."""
        return F.max(column).over(self.window().rowsBetween(-back, ahead))


DAILY = Series()


def numbered(
    df: DataFrame, series: Series, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, Series]:
    """Add each row's position ``_at`` (from 0) and its ``_block`` of ``block_rows`` rows, a power of two.

    Windows of the returned series order by block and position, as do windows inside a block, so a
    chain of both sorts the rows once. Positions and blocks of a split series are those in the whole series; each
    part begins with a block of its own.
    """
    if series.block_rows is not None and series.block_rows <= block_rows:
        return df, series
    if series.rows_per_part is None:
        at = (F.row_number().over(series.window()) - 1).cast("bigint")
        df = df.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / block_rows).cast("int"))
    else:
        blocks = -(-series.rows_per_part // block_rows)
        inside = F.col("_at") - F.col("_home") * series.rows_per_part
        df = df.withColumn("_block", F.col("_home") * F.lit(blocks) + F.floor(inside / block_rows))
    return df, replace(series, block_rows=block_rows)


def place_in_block(series: Series) -> Column:
    """The row's place in its block, from 0."""
    start = F.col("_home") * F.lit(series.rows_per_part) if series.rows_per_part else F.lit(0)
    return (F.col("_at") - start) % series.block_rows


def packed(df: DataFrame, needed: Sequence[str], name: str = "_rest") -> DataFrame:
    """Keep the needed columns, and all columns as one struct.

    Each step of a chain of windows copies its rows. Columns that only pass through are copied as
    one value, which keeps the generated code of the steps small enough to be compiled.
    """
    return df.select(F.struct(*df.columns).alias(name), *needed)


def unpacked(name: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(name)[c].alias(c) for c in columns]


def split_series(
    df: DataFrame,
    series: Series,
    rows_per_part: int = ROWS_PER_PART,
    back: int = HALO_BACK,
    ahead: int = HALO_AHEAD,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, Series]:
    """Cut series that are not bounded by definition into parts of ``rows_per_part`` rows.

    Each part also gets the rows just before and after it, so windows that reach no further give
    the same result in the part as in the whole series; the rows before it begin with a whole block. Compute over the
    returned series, then call :func:`home_rows`. (series, order) must be unique; rows without a time have no
    place in a series and are dropped, whether it is cut or not.
    """
    if back >= rows_per_part or ahead >= rows_per_part:
        raise ValueError("a part must be longer than its halo")
    df = df.where(F.col(series.order).isNotNull())
    if series.bounded:
        return df, series
    positions = ranked_values(df, series.by, series.order, rows_per_bucket).select(
        *series.by, series.order, F.col("_before").alias("_at")
    )
    home = F.floor(F.col("_at") / rows_per_part).cast("bigint")
    first_copied = (rows_per_part - back) // BLOCK_ROWS * BLOCK_ROWS
    inside = F.col("_at") - F.col("_home") * rows_per_part
    placed = join_null_safe(df, positions, [*series.by, series.order]).withColumn("_home", home)
    copies = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(inside >= first_copied, F.col("_home") + 1),
            F.when((inside < ahead) & (F.col("_home") > 0), F.col("_home") - 1),
        )
    )
    parts = placed.withColumn("_part", F.explode(copies))
    return parts, replace(series, by=(*series.by, "_part"), rows_per_part=rows_per_part)


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the copied edge rows of :func:`split_series`, if it made any."""
    if "_part" not in df.columns:
        return df
    return df.where(F.col("_part") == F.col("_home")).drop("_part", "_home", "_at", "_block")
