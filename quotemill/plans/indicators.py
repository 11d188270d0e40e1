"""Technical indicators per symbol, as a registry of column builders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import flag, safe_divide
from quotemill.operators.ewm import Ewm, from_span, with_ewm
from quotemill.operators.rolling import Rolling, with_rolling
from quotemill.operators.series import DAILY, Series, numbered, packed, unpacked
from quotemill.schemas import INDICATOR_NAMES

CLOSE = "adj_close"
WILDER = 1.0 / 14.0

ROLLINGS = {
    "_sma_20": Rolling(CLOSE, 20),
    "_sma_50": Rolling(CLOSE, 50),
    "_sma_200": Rolling(CLOSE, 200),
    "_std_14": Rolling("_return_1d", 14, "std"),
    "_std_21": Rolling("_return_1d", 21, "std"),
    "_std_60": Rolling("_return_1d", 60, "std"),
    "_gain_14": Rolling("_gain", 14),
    "_loss_14": Rolling("_loss", 14),
    "_volume_21": Rolling("volume", 21),
}
AVERAGES = {
    **{f"_ema_{n}": from_span(CLOSE, n) for n in (10, 20, 50, 12, 26)},
    "_plus_move": Ewm("_plus_dm", WILDER),
    "_minus_move": Ewm("_minus_dm", WILDER),
    "_true_range_avg": Ewm("_true_range", WILDER, "anywhere"),
}
SECOND_AVERAGES = {
    "_signal": from_span("_macd_line", 9),
    "_adx": Ewm("_dmi", WILDER, "anywhere"),
}


@dataclass(frozen=True)
class IndicatorSpec:
    """``build`` gives the column over a series; ``needs`` names its working columns."""

    name: str
    description: str
    build: Callable[[Series], Column]
    needs: tuple[str, ...] = ()


def _over(numerator, denominator) -> Column:
    return safe_divide(numerator, denominator) - 1


def _cross(series: Series, above: bool) -> Column:
    """The fast average passes the slow one on this row (an event, never null)."""
    fast, slow = F.col("_sma_50"), F.col("_sma_200")
    fast_before, slow_before = series.lag("_sma_50"), series.lag("_sma_200")
    if above:
        return flag(fast > slow) & flag(fast_before <= slow_before)
    return flag(fast < slow) & flag(fast_before >= slow_before)


def _rsi() -> Column:
    gain, loss = F.col("_gain_14"), F.col("_loss_14")
    # No losses at all: the ratio is infinite and the index 100; neither gains nor losses: missing.
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(
        100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss))
    )


def _spec(name, description, build, *needs) -> IndicatorSpec:
    return IndicatorSpec(name, description, build, needs)


_ALL = [
    _spec("return_1d", "1-day return", lambda s: F.col("_return_1d"), "_return_1d"),
    _spec("return_5d", "5-day return", lambda s: s.pct_change(CLOSE, 5)),
    _spec("return_14d", "14-day return", lambda s: s.pct_change(CLOSE, 14)),
    _spec("sma_20", "Close against its 20-day mean", lambda s: _over(CLOSE, "_sma_20"), "_sma_20"),
    _spec("sma_50", "Close against its 50-day mean", lambda s: _over(CLOSE, "_sma_50"), "_sma_50"),
    _spec("sma_200", "Close against its 200-day mean", lambda s: _over(CLOSE, "_sma_200"), "_sma_200"),
    _spec("sma_50_200_spread", "50-day mean against the 200-day mean",
          lambda s: _over("_sma_50", "_sma_200"), "_sma_50", "_sma_200"),
    _spec("golden_cross", "50-day mean rises above the 200-day mean",
          lambda s: _cross(s, True), "_sma_50", "_sma_200"),
    _spec("death_cross", "50-day mean falls below the 200-day mean",
          lambda s: _cross(s, False), "_sma_50", "_sma_200"),
    _spec("ema_10", "Close against its 10-day exponential mean", lambda s: _over(CLOSE, "_ema_10"), "_ema_10"),
    _spec("ema_20", "Close against its 20-day exponential mean", lambda s: _over(CLOSE, "_ema_20"), "_ema_20"),
    _spec("ema_50", "Close against its 50-day exponential mean", lambda s: _over(CLOSE, "_ema_50"), "_ema_50"),
    _spec("volatility_14d", "Deviation of daily returns, 14 days",
          lambda s: F.col("_std_14"), "_std_14"),
    _spec("volatility_21d", "Deviation of daily returns, 21 days",
          lambda s: F.col("_std_21"), "_std_21"),
    _spec("volatility_60d", "Deviation of daily returns, 60 days",
          lambda s: F.col("_std_60"), "_std_60"),
    _spec("momentum_7d", "Price change over 7 rows", lambda s: _over(CLOSE, s.lag(CLOSE, 7))),
    _spec("momentum_14d", "Price change over 14 rows", lambda s: _over(CLOSE, s.lag(CLOSE, 14))),
    _spec("rsi_14d", "Relative strength index, simple 14-row means", lambda s: _rsi(), "_gain_14", "_loss_14"),
    _spec("macd", "12 less 26-day exponential mean, per close",
          lambda s: safe_divide("_macd_line", CLOSE), "_macd_line"),
    _spec("macd_signal", "9-day exponential mean of the MACD line, per close",
          lambda s: safe_divide("_signal", CLOSE), "_signal"),
    _spec("macd_histogram", "MACD less its signal",
          lambda s: safe_divide("_macd_line", CLOSE) - safe_divide("_signal", CLOSE), "_macd_line", "_signal"),
    _spec("dmi", "Directional movement index", lambda s: F.col("_dmi"), "_dmi"),
    _spec("adx", "Smoothed directional movement index", lambda s: F.col("_adx"), "_adx"),
    _spec("intraday_range", "High less low, per close",
          lambda s: safe_divide(F.col("adj_high") - F.col("adj_low"), CLOSE)),
    _spec("gap", "Open against the previous close",
          lambda s: safe_divide(F.col("adj_open") - s.lag(CLOSE), s.lag(CLOSE))),
    _spec("relative_volume_21d", "Volume against its 21-day mean",
          lambda s: safe_divide(F.col("volume").cast("double"), "_volume_21"), "_volume_21"),
]

INDICATORS: dict[str, IndicatorSpec] = {spec.name: spec for spec in _ALL}
assert list(INDICATORS) == INDICATOR_NAMES

# What a working column is computed from, apart from the price columns.
_REQUIRES = {
    **{name: (spec.column,) for name, spec in ROLLINGS.items()},
    **{name: (spec.column,) for name, spec in AVERAGES.items() if spec.column != CLOSE},
    **{name: (spec.column,) for name, spec in SECOND_AVERAGES.items()},
    "_macd_line": ("_ema_12", "_ema_26"),
    "_plus_di": ("_plus_move", "_true_range_avg"),
    "_minus_di": ("_minus_move", "_true_range_avg"),
    "_dmi": ("_plus_di", "_minus_di"),
}
PRICE_COLUMNS = ["adj_close", "adj_open", "adj_high", "adj_low", "volume"]


def _closure(names) -> set[str]:
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _REQUIRES.get(name, ())
    return wanted


def _row_columns(series: Series) -> dict[str, Column]:
    """Working columns that read the row and the previous row."""
    previous = series.lag(CLOSE)
    up = F.col("adj_high") - series.lag("adj_high")
    down = series.lag("adj_low") - F.col("adj_low")
    return {
        "_return_1d": series.pct_change(CLOSE, 1),
        "_gain": F.greatest(F.coalesce(F.col(CLOSE) - previous, F.lit(0.0)), F.lit(0.0)),
        "_loss": F.greatest(F.coalesce(previous - F.col(CLOSE), F.lit(0.0)), F.lit(0.0)),
        "_plus_dm": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)),
        "_minus_dm": F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)),
        # Signed differences: the largest of them, missing ones skipped.
        "_true_range": F.greatest(
            F.col("adj_high") - F.col("adj_low"),
            F.col("adj_high") - previous,
            F.col("adj_low") - previous,
        ),
    }


def _lines(series: Series) -> dict[str, Column]:
    return {
        "_macd_line": F.col("_ema_12") - F.col("_ema_26"),
        "_plus_di": 100 * safe_divide("_plus_move", "_true_range_avg"),
        "_minus_di": 100 * safe_divide("_minus_move", "_true_range_avg"),
    }


def _movement_index(series: Series) -> dict[str, Column]:
    plus, minus = F.col("_plus_di"), F.col("_minus_di")
    return {"_dmi": 100 * safe_divide(F.abs(plus - minus), F.abs(plus + minus))}


# The working columns in the order they can be computed. Each stage is one set of windows or one
# projection over the columns before it, since a window cannot take another window as its input.
_STAGES = [
    _row_columns, ROLLINGS, AVERAGES, _lines, _movement_index, SECOND_AVERAGES,
]


def _add_stage(df: DataFrame, stage, wanted: set[str], series: Series) -> DataFrame:
    columns = stage(series) if callable(stage) else stage
    some = {n: c for n, c in columns.items() if n in wanted}
    if not some:
        return df
    if callable(stage):
        return df.withColumns(some)
    if stage is ROLLINGS:
        return with_rolling(df, series, some)
    return with_ewm(df, series, some)


def compute_stock_indicators(
    df: DataFrame, names=None, series: Series = DAILY
) -> DataFrame:
    """Add the named indicators (all of them by default) to a price table, one row per bar.

    Everything is windows over the series: one shuffle by its keys. An indicator is finished as
    soon as its working columns are there, and travels on as part of a struct; working columns are
    dropped when nothing needs them any more.
    """
    names = list(INDICATORS) if names is None else list(names)
    specs = {name: INDICATORS[name] for name in names}
    return _run_stages(df, specs, names, series)


def _run_stages(df: DataFrame, specs: dict[str, IndicatorSpec], names, series: Series) -> DataFrame:
    keep = [c for c in df.columns if c not in names]
    df, series = numbered(df.select(*keep), series)
    carried = [*dict.fromkeys([*series.by, *series.positions, series.order])]
    inputs = [c for c in PRICE_COLUMNS if c in keep]
    df = packed(df, [*dict.fromkeys([*carried, *inputs])])
    always = df.columns
    pending, structs, at = dict(specs), [], {}
    available: set[str] = set()
    for i, stage in enumerate(_STAGES):
        wanted = _closure(need for spec in pending.values() for need in spec.needs) - available
        df = _add_stage(df, stage, wanted, series)
        available = {c for c in df.columns if c.startswith("_")}
        ready = [n for n, spec in pending.items() if set(spec.needs) <= available]
        if not ready:
            continue
        done = F.struct(*[pending.pop(n).build(series).alias(n) for n in ready]).alias(f"_done_{i}")
        needed = _closure(need for spec in pending.values() for need in spec.needs)
        working = [c for c in df.columns if c in needed]
        df = df.select(*always, *structs, *working, done)
        structs.append(f"_done_{i}")
        at.update({n: f"_done_{i}" for n in ready})
    return df.select(*unpacked("_rest", keep), *[F.col(at[n])[n].alias(n) for n in names])


def directional_indicators(df: DataFrame, series: Series = DAILY) -> DataFrame:
    """Add ``plus_di`` and ``minus_di``, the inputs of the directional movement index."""
    specs = {
        name: _spec(name, "directional indicator", lambda s, c=f"_{name}": F.col(c), f"_{name}")
        for name in ("plus_di", "minus_di")
    }
    return _run_stages(df, specs, list(specs), series)
