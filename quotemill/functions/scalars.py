"""Column helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.schemas import RATING_INDEX


def safe_divide(numerator, denominator) -> Column:
    """Division that is null for a zero denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def flag(condition: Column) -> Column:
    """A comparison that is false, never null, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def label_index(column="label") -> Column:
    """Class index of a rating."""
    value = _col(column)
    out = F.when(value == "DOWN", RATING_INDEX["DOWN"])
    for name in ("HOLD", "UP"):
        out = out.when(value == name, RATING_INDEX[name])
    return out.cast("bigint")


def rating_of(value, threshold) -> Column:
    """UP above the threshold, DOWN below its negative, HOLD otherwise."""
    value, threshold = _col(value), _col(threshold)
    return F.when(value > threshold, "UP").when(value < -threshold, "DOWN").otherwise("HOLD")


def polarity(p_positive="p_positive", p_negative="p_negative") -> Column:
    return _col(p_positive) - _col(p_negative)


def is_positive(p="p_positive", n="p_negative", z="p_neutral") -> Column:
    return flag(_col(p) > F.greatest(_col(n), _col(z)))


def is_negative(p="p_positive", n="p_negative", z="p_neutral") -> Column:
    return flag(_col(n) > F.greatest(_col(p), _col(z)))


def to_float32(df: DataFrame, columns) -> DataFrame:
    """Cast the double columns among ``columns`` to float, leaving other types alone."""
    wanted = set(columns)
    casts = {
        f.name: F.col(f.name).cast("float")
        for f in df.schema.fields
        if f.name in wanted and f.dataType.typeName() == "double"
    }
    return df.withColumns(casts) if casts else df


def zero_fill(df: DataFrame, columns) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.fillna(0, subset=present) if present else df


def suffix_columns(df: DataFrame, columns, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def argmax_class(*probabilities) -> Column:
    """Index of the largest value, the first one on ties."""
    values = F.array(*[_col(p) for p in probabilities])
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def single_row(df: DataFrame) -> Column:
    """The only row of a table as a struct: a scalar subquery, run once, without a join."""
    return df.select(F.struct(*df.columns)).scalar()


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
