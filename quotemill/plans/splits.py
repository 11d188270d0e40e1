"""Chronological and walk-forward splits, symbol samples and leakage checks.

Split boundaries come from the numbered distinct dates, which are bounded by the calendar; they
reach the dataset as scalar subqueries, so splitting is a projection of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import single_row
from quotemill.operators.buckets import hashed_positions
from quotemill.schemas import MAX_SPAN_DAYS

# Share of the dates in each split.
TRAIN_SHARE = 0.72
VALIDATION_SHARE = 0.13


class LeakageError(AssertionError):
    """A training label reaches into the rows it is validated on."""


def numbered_dates(df: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based index ``idx``."""
    return (
        df.select("date")
        .distinct()
        .select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("idx"))
    )


def _cut(count: Column, share: float) -> Column:
    return F.floor(count * F.lit(share))


def _before(date: Column, days: int) -> Column:
    return date - F.make_dt_interval(F.lit(days))


def split_bounds(
    df: DataFrame, train_share: float = TRAIN_SHARE, validation_share: float = VALIDATION_SHARE
) -> DataFrame:
    """One row: the first date after the training part and the first test date."""
    dates = numbered_dates(df)
    size = dates.agg(F.count(F.lit(1)).alias("n")).scalar()

    def date_at(share: float) -> Column:
        return F.max(F.when(F.col("idx") == _cut(size, share), F.col("date")))

    return dates.agg(
        date_at(train_share).alias("train_end"),
        date_at(train_share + validation_share).alias("test_start"),
    )


def chronological_split(
    df: DataFrame,
    train_share: float = TRAIN_SHARE,
    validation_share: float = VALIDATION_SHARE,
    days_gap: int = MAX_SPAN_DAYS,
) -> DataFrame:
    """Add ``split`` (train, val, test) and drop the rows in the gaps before each boundary."""
    bounds = single_row(split_bounds(df, train_share, validation_share))
    train_end, test_start = bounds["train_end"], bounds["test_start"]
    date = F.col("date")
    split = (
        F.when(date < _before(train_end, days_gap), "train")
        .when((date >= train_end) & (date < _before(test_start, days_gap)), "val")
        .when(date >= test_start, "test")
    )
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def split_date_ranges(split: DataFrame) -> DataFrame:
    """First and last date of each split."""
    return split.groupBy("split").agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_date"),
    )


def fold_table(
    dates_of: DataFrame,
    n_folds: int,
    initial_train_share: float = 0.5,
    train_share: float = TRAIN_SHARE,
    validation_share: float = VALIDATION_SHARE,
    days_gap: int = MAX_SPAN_DAYS,
) -> DataFrame:
    """One row per fold: ``fold``, ``val_start`` and ``val_end``.

    Only the dates before the test part, less the gap, are used. The first share of them is only
    trained on, the rest is cut into ``n_folds`` consecutive blocks.
    """
    dates = numbered_dates(dates_of)
    test_start = split_bounds(dates_of, train_share, validation_share).select("test_start").scalar()
    usable = dates.where(F.col("date") < _before(test_start, days_gap))
    size = usable.agg(F.count(F.lit(1)).alias("n"))
    start = _cut(F.col("n"), initial_train_share)
    step = (F.col("n") - start) / F.lit(float(n_folds))
    # Evenly spaced cut points, truncated; the last one is the number of dates.
    cut = lambda i: F.when(i == n_folds, F.col("n")).otherwise(
        F.floor(i * step + start)
    )
    folds = size.select(
        "n", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    ).select(
        F.col("fold").cast("bigint").alias("fold"),
        cut(F.col("fold")).alias("_first"),
        (cut(F.col("fold") + 1) - 1).alias("_last"),
    )
    first = usable.select(F.col("idx").alias("_first"), F.col("date").alias("val_start"))
    last = usable.select(F.col("idx").alias("_last"), F.col("date").alias("val_end"))
    return folds.join(first, "_first").join(last, "_last").select("fold", "val_start", "val_end")


def walk_forward_splits(
    df: DataFrame,
    n_folds: int,
    initial_train_share: float = 0.5,
    train_share: float = TRAIN_SHARE,
    validation_share: float = VALIDATION_SHARE,
    days_gap: int = MAX_SPAN_DAYS,
    boundary_dates: DataFrame | None = None,
) -> DataFrame:
    """Rows of every fold with ``fold`` and ``role`` (train or val); training parts grow.

    A row is copied once per fold, in place and without a shuffle, and kept in those it is in.
    """
    folds = fold_table(
        df if boundary_dates is None else boundary_dates,
        n_folds,
        initial_train_share,
        train_share,
        validation_share,
        days_gap,
    )
    listed = folds.agg(
        F.sort_array(F.collect_list(F.struct("fold", "val_start", "val_end"))).alias("_folds")
    ).scalar()
    date, fold = F.col("date"), F.col("_fold")
    trained = date < _before(fold["val_start"], days_gap)
    validated = (date >= fold["val_start"]) & (date <= fold["val_end"])
    return (
        df.withColumn("_fold", F.explode(listed))
        .withColumns(
            {
                "fold": fold["fold"],
                "role": F.when(trained, "train").when(validated, "val"),
            }
        )
        .where(F.col("role").isNotNull())
        .drop("_fold")
    )


def sample_symbols(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Keep all rows of a seeded sample of whole symbols: max(1, round(n x fraction)) of them."""
    symbols = df.select("symbol").distinct()
    # A symbol is in the sample when fewer than n_keep symbols have a smaller hash; the order is
    # taken over the symbol table only.
    keep = sampled_symbols(symbols, fraction, seed)
    return df.join(keep, "symbol", "left_semi")


def sampled_symbols(symbols: DataFrame, fraction: float, seed: int) -> DataFrame:
    wanted = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction))).cast("bigint")
    n_keep = symbols.agg(wanted.alias("n")).scalar()
    whole = symbols.withColumn("_all", F.lit(0))
    placed = hashed_positions(whole, ["_all"], ["symbol"], seed, "_position")
    return placed.where(F.col("_position") < n_keep).select("symbol")


def leakage_report(folds: DataFrame, test_start: DataFrame) -> DataFrame:
    """Per fold: last training label date, first validation date, and whether they are apart."""
    per_fold = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("label_end_date"))).alias("last_train_label"),
        F.min(F.when(F.col("role") == "val", F.col("date"))).alias("first_val"),
        F.max(F.when(F.col("role") == "val", F.col("date"))).alias("last_val"),
    )
    return per_fold.select(
        "fold",
        "last_train_label",
        "first_val",
        "last_val",
        (F.col("last_train_label") < F.col("first_val")).alias("train_is_clean"),
        (F.col("last_val") < test_start.select("test_start").scalar()).alias("test_is_clean"),
    )


def assert_no_leakage(folds: DataFrame, test_start: DataFrame) -> None:
    """Fail when a fold's training labels or validation rows reach too far."""
    bad = leakage_report(folds, test_start).where(
        ~(F.col("train_is_clean") & F.col("test_is_clean"))
    )
    found = bad.head(1)
    if found:
        raise LeakageError(f"fold {found[0]['fold']} leaks: {found[0].asDict()}")
