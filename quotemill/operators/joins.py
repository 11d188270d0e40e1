"""Joins with the checks and the skew handling the plans need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeysError(ValueError):
    """A side of a one-to-one join has a repeated key."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys held by more than one row."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    found = duplicate_keys(df, keys).head(1)
    if found:
        raise DuplicateKeysError(f"{what} has more than one row for {found[0].asDict()}")


def left_join_one_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = True
) -> DataFrame:
    """Left join that keeps exactly the left rows; both sides must be unique on the keys."""
    keys = list(keys)
    if validate:
        assert_unique(left, keys, "the left side")
        assert_unique(right, keys, "the right side")
    return left.join(right, keys, "left")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, keeping the keys of ``left`` once.

    Spark joins on null-safe equality by hash or sort like on plain equality.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return left.join(renamed, condition, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def left_join_on_text(left: DataFrame, right: DataFrame, column: str, row_key: Sequence[str]) -> DataFrame:
    """Left join on a nullable text column of which ``right`` has one row per text.

    Rows without a text match nothing. They are spread by a hash of ``row_key`` instead of all
    meeting in the partition of the null key.
    """
    spread = F.when(F.col(column).isNotNull(), F.xxhash64(column)).otherwise(
        F.xxhash64(*row_key, F.lit(1))
    )
    scores = right.where(F.col(column).isNotNull()).withColumnRenamed(column, "_text")
    scores = scores.withColumn("_spread", F.xxhash64("_text"))
    keyed = left.withColumn("_spread", spread)
    return keyed.join(
        scores,
        (keyed["_spread"] == scores["_spread"]) & (keyed[column] == scores["_text"]),
        "left",
    ).drop("_spread", "_text")


def missing_keys(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of ``left`` that ``right`` does not have."""
    return (
        left.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .join(right.select(column), column, "left_anti")
    )
