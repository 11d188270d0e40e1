"""Exponentially weighted averages with the recursive definition, as window expressions.

``y0 = x0`` and ``y = alpha * x + q * y_prev`` with ``q = 1 - alpha``. Unrolled, ``y`` is a weighted
sum, and scaling every term by ``q ** -offset`` turns it into a running sum. The scale would
overflow on a long series, so the series is cut into blocks: a running sum inside the block, plus
what all earlier blocks carry over. The average at the end of a block is an affine map of the one at the
end of the block before it. A bounded series folds these maps in the last row of each block. The parts of a
split one hand them to a table of one row per block, where they are composed in a logarithmic scan, and get the
carries back. No history is cut off: small averages matter where two of them are divided by each other.

After a gap of ``k`` rows (missing values in between) the recursion is
``y = (q**k * y_prev + alpha * x) / (q**k + alpha)``, that is a linear recursion with a factor that
changes by row; the scale is then the running product of the factors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import join_null_safe
from quotemill.operators.series import BLOCK_ROWS, Series, numbered, place_in_block
from quotemill.session import staged

# The scale inside a block stays below exp(LARGEST_EXPONENT), with a gap in it below exp(OVERFLOW).
LARGEST_EXPONENT = 300.0
OVERFLOW = 690.0


@dataclass(frozen=True)
class Ewm:
    """One average: the input column, its alpha, and what the input can be missing.

    ``missing``: ``never``, ``leading`` (only before the first value) or ``anywhere``.
    """

    column: str
    alpha: float
    missing: str = "never"

    @property
    def log_q(self) -> float:
        return math.log(1.0 - self.alpha)


def from_span(column: str, span: int, missing: str = "never") -> Ewm:
    return Ewm(column, 2.0 / (span + 1.0), missing)


def with_ewm(df: DataFrame, series: Series, outputs: dict[str, Ewm]) -> DataFrame:
    """Add the average ``outputs[name]`` as column ``name``, all in one pass over the series.

    A series that is not :func:`numbered` yet is numbered here. The parts of a split series give the same
    averages as the whole: what a block needs to know about earlier ones comes from two small tables of one row per block.
    """
    keep = df.columns
    fastest = max(spec.alpha for spec in outputs.values())
    longest = int(LARGEST_EXPONENT / -math.log(1.0 - fastest))
    if "_block" in keep:  # fast averages need smaller blocks than the caller's
        df = df.withColumn("_outer_block", F.col("_block"))
    df, series = numbered(df, series, min(2 ** int(math.log2(longest)), BLOCK_ROWS))
    block_rows = series.block_rows
    df = df.withColumn("_off", place_in_block(series).cast("double"))
    running = Window.partitionBy(*series.by, "_block").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0
    )

    # Stage 1: which row starts the series, and how far back the previous value is.
    sparse = {n: spec.column for n, spec in outputs.items() if spec.missing != "never"}
    df = with_seen(df, series, sparse)

    # Stage 2: scale exponent per row (a running sum of log factors where gaps are possible).
    gaps: dict[str, Column] = {}
    for name, spec in outputs.items():
        if spec.missing == "anywhere":
            gaps[f"_log_{name}"] = F.sum(_log_factor(name, spec, block_rows)).over(running)
    df = df.withColumns(gaps) if gaps else df

    # Stage 3: running scaled sum inside the block.
    sums = {
        f"_sum_{name}": F.sum(_scaled_term(name, spec, block_rows)).over(running)
        for name, spec in outputs.items()
    }
    df = df.withColumns(sums)
    df = df.withColumns(
        {f"_in_{name}": F.exp(_exponent(name, spec)) * F.col(f"_sum_{name}") for name, spec in outputs.items()}
    )

    # Stage 4: what earlier blocks carry into this one.
    df = _with_carries(df, series, outputs)

    results: dict[str, Column] = {}
    for name, spec in outputs.items():
        # A row without a value repeats the average of the row before it: nothing is added, no weight changes.
        value = F.col(f"_in_{name}") + _block_decay(name, spec) * F.col(f"_carry_{name}")
        results[name] = value if spec.missing == "never" else F.when(F.col(f"_seen_{name}") > 0, value)
    kept = [F.col("_outer_block").alias(c) if c == "_block" else F.col(c) for c in keep if c not in results]
    return df.select(*kept, *[v.alias(n) for n, v in results.items()])


def with_seen(df: DataFrame, series: Series, columns: dict[str, str]) -> DataFrame:
    """Add ``_seen_<name>``, the values of a column up to here, and ``_prev_<name>``, where the previous one is."""
    if not columns:
        return df
    before: dict[str, Column] = {}
    if series.rows_per_part:
        df = staged(df, "series-parts")
        facts = {}
        for name, column in columns.items():
            x = F.col(column)
            facts[f"_n_{name}"] = F.count(x)
            facts[f"_at_{name}"] = F.max(F.when(x.isNotNull(), F.col("_at")))
        earlier = Window.partitionBy(*series.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ends = _home(df).groupBy(*series.keys, "_block").agg(*[c.alias(n) for n, c in facts.items()])
        known = ends.select(
            *series.keys, "_block",
            *[F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_n_{n}") for n in columns],
            *[F.max(f"_at_{n}").over(earlier).alias(f"_at_{n}") for n in columns],
        )
        df = join_null_safe(df, known, [*series.keys, "_block"])
        own = Window.partitionBy(*series.by, "_block").orderBy("_at")
        before = {n: F.col(f"_at_{n}") for n in columns}
    else:
        own = series.window()
    added: dict[str, Column] = {}
    for name, column in columns.items():
        x = F.col(column)
        seen = F.count(x).over(own.rowsBetween(Window.unboundedPreceding, 0))
        prev = F.last(F.when(x.isNotNull(), F.col("_at")), True).over(own.rowsBetween(Window.unboundedPreceding, -1))
        added[f"_seen_{name}"] = seen + F.col(f"_n_{name}") if before else seen
        added[f"_prev_{name}"] = F.coalesce(prev, before[name]) if before else prev
    return df.withColumns(added).drop(*[f"_{kind}_{n}" for n in columns for kind in ("n", "at")])


def _home(df: DataFrame) -> DataFrame:
    return df.where(F.col("_part") == F.col("_home"))


def _with_carries(df: DataFrame, series: Series, outputs: dict[str, Ewm]) -> DataFrame:
    """Add ``_carry_<name>``, the average at the end of the block before; 0 in the first block."""
    if series.rows_per_part:
        # One row per block: the map from the average before the block to the one at its end.
        df = staged(df, "series-parts")
        maps = [
            F.struct(F.col(f"_in_{n}").alias("sum"), _block_decay(n, spec).alias("decay")).alias(n)
            for n, spec in outputs.items()
        ]
        last = F.max(F.struct("_at", *maps)).alias("_end")
        ends = _home(df).groupBy(*series.keys, "_block").agg(last)
        ends = staged(ends.select(*series.keys, "_block", *[F.col("_end")[n].alias(n) for n in outputs]), "series-blocks")
        carries = affine_scan(ends, series.keys, "_block", list(outputs))
        carries = carries.withColumnsRenamed({n: f"_carry_{n}" for n in outputs})
        return join_null_safe(df, carries, [*series.keys, "_block"])
    # The ends of all blocks are only looked at in the last row of one; other rows never hold the list.
    whole = series.window()
    earlier_blocks = (
        Window.partitionBy(*series.by).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_last", ~F.col("_block").eqNullSafe(F.lead("_block").over(whole)))
    ends, folded, carried = {}, {}, {}
    for name, spec in outputs.items():
        end = F.struct(F.col(f"_in_{name}").alias("sum"), _block_decay(name, spec).alias("decay"))
        ends[f"_ends_{name}"] = F.collect_list(F.when(F.col("_last"), end)).over(earlier_blocks)
        before = F.aggregate(
            f"_ends_{name}", F.lit(0.0), lambda carry, end: end["sum"] + end["decay"] * carry
        )
        folded[f"_end_{name}"] = F.when(
            F.col("_last"), F.col(f"_in_{name}") + _block_decay(name, spec) * before
        )
        carried[f"_carry_{name}"] = F.coalesce(
            F.last(f"_end_{name}", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        )
    return df.withColumns(ends).withColumns(folded).drop(*ends).withColumns(carried)


def affine_scan(maps: DataFrame, keys: Sequence[str], order: str, names: Sequence[str]) -> DataFrame:
    """What comes into each row when the maps ``x -> sum + decay * x`` of all rows before it are applied to 0.

    ``maps`` has structs ``(sum, decay)`` under ``names`` and is read several times, so it should be stored. Step k
    composes each row's map with that of 2^k rows before, which covers 2^(k+1) rows: the steps are the
    logarithm of the longest series of rows, all of them windows over one order.
    """
    longest = maps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    window = Window.partitionBy(*keys).orderBy(order)
    step = 1
    while step < longest:
        lagged = maps.withColumns({f"_lag_{n}": F.lag(n, step).over(window) for n in names})
        composed = {}
        for n in names:
            # Rows without a partner reach back to the start already, where the average is 0.
            add = F.coalesce(F.col(n)["decay"] * F.col(f"_lag_{n}")["sum"], F.lit(0.0))
            decay = F.coalesce(F.col(n)["decay"] * F.col(f"_lag_{n}")["decay"], F.lit(0.0))
            composed[n] = F.struct((F.col(n)["sum"] + add).alias("sum"), decay.alias("decay"))
        maps = lagged.select(*keys, order, *[c.alias(n) for n, c in composed.items()])
        step *= 2
    # A row's own map is part of its result; what comes into it is the result of the row before.
    into = [F.coalesce(F.lag(F.col(n)["sum"]).over(window), F.lit(0.0)).alias(n) for n in names]
    return maps.select(*keys, order, *into)


def _gap_weight(name: str, spec: Ewm, block_rows: int) -> Column:
    """q ** k for the distance k to the previous value, as far as the scale of the block leaves room."""
    longest = int(OVERFLOW / -spec.log_q) - block_rows
    k = F.least(F.col("_at") - F.col(f"_prev_{name}"), F.lit(longest))
    return F.exp(F.lit(spec.log_q) * k)


def _log_factor(name: str, spec: Ewm, block_rows: int) -> Column:
    weight = _gap_weight(name, spec, block_rows)
    factor = F.log(weight / (weight + F.lit(spec.alpha)))
    present = F.col(spec.column).isNotNull() & F.col(f"_prev_{name}").isNotNull()
    return F.when(present, factor).otherwise(F.lit(0.0))


def _exponent(name: str, spec: Ewm) -> Column:
    """Log of the weight of the block's first row, as seen from this row."""
    if spec.missing == "anywhere":
        return F.col(f"_log_{name}")
    return F.lit(spec.log_q) * F.col("_off")


def _block_decay(name: str, spec: Ewm) -> Column:
    """Weight of the value at the previous block's end, as seen from this row."""
    if spec.missing == "anywhere":
        return F.exp(F.col(f"_log_{name}"))
    return F.exp(F.lit(spec.log_q) * (F.col("_off") + 1))


def _scaled_term(name: str, spec: Ewm, block_rows: int) -> Column:
    x = F.col(spec.column)
    if spec.missing == "never":  # `_at` counts from the start of the whole series
        share = F.when(F.col("_at") == 0, F.lit(1.0)).otherwise(F.lit(spec.alpha))
    elif spec.missing == "leading":
        share = F.when(F.col(f"_seen_{name}") == 1, F.lit(1.0)).otherwise(F.lit(spec.alpha))
    else:
        share = F.when(F.col(f"_prev_{name}").isNull(), F.lit(1.0)).otherwise(
            F.lit(spec.alpha) / (_gap_weight(name, spec, block_rows) + F.lit(spec.alpha))
        )
    return F.coalesce(share * x * F.exp(-_exponent(name, spec)), F.lit(0.0))


def with_ewm_std(
    df: DataFrame, series: Series, column: str, span: int, min_periods: int, out: str
) -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation of a series without inner gaps."""
    alpha = 2.0 / (span + 1.0)
    q = 1.0 - alpha
    keep = [c for c in df.columns if c != out]
    df, series = numbered(df, series)
    squared = df.withColumn("_square", F.col(column) * F.col(column))
    averaged = with_ewm(
        squared,
        series,
        {
            "_mean": Ewm(column, alpha, "leading"),
            "_mean_square": Ewm("_square", alpha, "leading"),
        },
    )
    averaged = with_seen(averaged, series, {"periods": column}).withColumnRenamed("_seen_periods", "_periods")
    older = F.pow(F.lit(q), 2 * (F.col("_periods") - 1))
    weights_squared = older + F.lit(alpha * alpha / (1 - q * q)) * (1 - older)
    variance = F.try_divide(
        F.col("_mean_square") - F.col("_mean") * F.col("_mean"), 1 - weights_squared
    )
    value = F.when(
        F.col("_periods") >= max(min_periods, 2), F.sqrt(F.greatest(variance, F.lit(0.0)))
    )
    return averaged.select(*keep, value.alias(out))
