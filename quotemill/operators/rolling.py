"""Rolling means and deviations over long frames, at a cost that does not grow with the frame.

A sliding frame is re-aggregated for every row, so a 200-row mean costs 200 steps a row. Here the
frame is put together from equal shorter frames: the 10-row mean of this row, of 10 rows back, of 20
rows back and so on. Means and squared deviations are merged by their exact formulas; nothing is
subtracted out of a longer sum, so an extreme value leaves no trace once it has left the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.series import Series, numbered

# Up to this length a plain frame is as cheap; reading a row further back costs about five steps.
SHORT = 32
LOOK_BACK_COST = 5


@dataclass(frozen=True)
class Rolling:
    """A statistic (``mean`` or ``std``) of the last ``rows`` rows, null until they are all there."""

    column: str
    rows: int
    statistic: str = "mean"


def plan_pieces(outputs: dict[str, Rolling]) -> dict[str, int]:
    """Length of the shorter frame each output is put together from, shared where that is cheaper."""
    chosen: dict[tuple[str, str], set[int]] = {}
    pieces: dict[str, int] = {}
    for name, spec in sorted(outputs.items(), key=lambda item: item[1].rows):
        shared = chosen.setdefault((spec.column, spec.statistic), set())
        lengths = [spec.rows]
        if spec.rows > SHORT:
            lengths += [d for d in range(2, spec.rows) if spec.rows % d == 0]
        cost = {
            d: (0 if d in shared else d) + LOOK_BACK_COST * (spec.rows // d - 1) for d in lengths
        }
        best = min(lengths, key=lambda d: (cost[d], d))
        shared.add(best)
        pieces[name] = best
    return pieces


def with_rolling(df: DataFrame, series: Series, outputs: dict[str, Rolling]) -> DataFrame:
    """Add the rolling statistic ``outputs[name]`` as column ``name``, all over one ordering."""
    keep = df.columns
    pieces = plan_pieces(outputs)
    short: dict[str, Column] = {}
    for name, spec in outputs.items():
        n = pieces[name]
        x = F.col(spec.column).cast("double")
        if spec.statistic == "mean" or n < spec.rows:
            short[_mean_name(spec, n)] = series.rolling(F.avg, x, n)
        if spec.statistic == "std":
            short[_spread_name(spec, n)] = series.rolling(F.var_pop, x, n)
    df = df.withColumns(short)
    means = {
        f"_mean_{name}": _merged_mean(series, spec, pieces[name])
        for name, spec in outputs.items()
        if spec.statistic == "std" and pieces[name] < spec.rows
    }
    df = df.withColumns(means) if means else df
    return df.select(
        *[c for c in keep if c not in outputs],
        *[_merged(series, name, spec, pieces[name]).alias(name) for name, spec in outputs.items()],
    )


def _merged_mean(series: Series, spec: Rolling, piece: int) -> Column:
    means = [_back(series, _mean_name(spec, piece), k) for k in range(0, spec.rows, piece)]
    return _total(means) / len(means)


def _merged(series: Series, name: str, spec: Rolling, piece: int) -> Column:
    if spec.statistic == "mean":
        return _merged_mean(series, spec, piece)
    if piece == spec.rows:
        return F.sqrt(F.col(_spread_name(spec, piece)) * F.lit(piece / (piece - 1.0)))
    parts = []
    for k in range(0, spec.rows, piece):
        away = _back(series, _mean_name(spec, piece), k) - F.col(f"_mean_{name}")
        parts.append(_back(series, _spread_name(spec, piece), k) + away * away)
    return F.sqrt(_total(parts) * F.lit(float(piece)) / F.lit(spec.rows - 1.0))


def _back(series: Series, column: str, rows: int) -> Column:
    return series.lag(column, rows) if rows else F.col(column)


def _total(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _mean_name(spec: Rolling, piece: int) -> str:
    return f"_mean_{piece}_{spec.column}"


def _spread_name(spec: Rolling, piece: int) -> str:
    return f"_spread_{piece}_{spec.column}"


def near_flag(df: DataFrame, series: Series, flag: str, back: int, ahead: int, out: str) -> DataFrame:
    """Add whether ``flag`` is set in this row, the ``back`` rows before or the ``ahead`` rows after."""
    keep = [c for c in df.columns if c != out]
    df, series = numbered(df, series)
    latest = F.last(F.when(F.col(flag), F.col("_at")), True).over(series.so_far())
    recent = F.coalesce(F.col("_at") - latest <= back, F.lit(False))
    coming = F.max(flag).over(series.window().rowsBetween(0, ahead))
    return df.select(*keep, (recent | coming).alias(out))
