"""Evaluation of class probabilities: rank correlations, deciles, calibration and baselines.

A prediction table has the evaluation columns of the test rows and ``p_down``, ``p_hold``, ``p_up``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.scalars import argmax_class, label_index, rating_of, single_row
from quotemill.operators.asof import asof_join
from quotemill.operators.buckets import (
    BOUNDED,
    ROWS_PER_BUCKET,
    group_quantiles,
    quantile_bucket,
    with_average_ranks,
    with_pct_rank,
)
from quotemill.schemas import LABEL_HORIZON, MIN_ROWS_PER_DATE, RATINGS

PROBABILITIES = ["p_down", "p_hold", "p_up"]
TERCILES = [1, 2, 3]
QUINTILES = [1, 2, 3, 4, 5]
# Smallest probability the log loss takes (double precision).
EPSILON = 2.220446049250313e-16


def independent_dates(daily: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """Every (horizon + 1)-th date of a per-date table, so label windows do not overlap."""
    at = F.row_number().over(Window.orderBy("date")) - 1
    return daily.withColumn("_at", at).where(F.col("_at") % (horizon + 1) == 0).drop("_at")


def t_stat(column: str) -> Column:
    """Mean over its standard error, an aggregate over a thinned per-date table."""
    return F.try_divide(
        F.avg(column), F.try_divide(F.stddev_samp(column), F.sqrt(F.count(column).cast("double")))
    )


def t_stats(daily: DataFrame, columns: Sequence[str], horizon: int = LABEL_HORIZON) -> DataFrame:
    """One row with ``<column>_t`` of each per-date column, on the dates of its own series.

    ``_in_<column>`` tells which dates belong to the series, also where its value is missing.
    """
    stacked = daily.select(
        "date",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("_series"),
                        F.col(c).alias("_value"),
                        F.col(f"_in_{c}").alias("_in"),
                    )
                    for c in columns
                ]
            )
        ).alias("_item"),
    )
    stacked = stacked.select("date", "_item.*").where(F.col("_in"))
    own = Window.partitionBy("_series").orderBy("date")
    thinned = stacked.withColumn("_at", F.row_number().over(own) - 1).where(
        F.col("_at") % (horizon + 1) == 0
    )
    return thinned.agg(
        *[t_stat_where("_value", F.col("_series") == c).alias(f"{c}_t") for c in columns]
    )


def t_stat_where(column: str, condition: Column) -> Column:
    value = F.when(condition, F.col(column))
    return F.try_divide(
        F.avg(value), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value).cast("double")))
    )


def rank_ic(
    df: DataFrame,
    score: str,
    target: str,
    keys: Sequence[str] = ("date",),
    min_rows: int = MIN_ROWS_PER_DATE,
    rows_per_bucket: int | None = BOUNDED,
) -> DataFrame:
    """Spearman correlation per group (``ic``), groups with fewer than ``min_rows`` rows left out."""
    keys = list(keys)
    ranked = with_average_ranks(
        df.select(*keys, F.col(score).alias("_score"), F.col(target).alias("_target")),
        keys,
        {"_x": "_score", "_y": "_target"},
        rows_per_bucket=rows_per_bucket,
    )
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    ic = F.try_divide(F.covar_pop("_x", "_y"), spread)
    # Unrelated ranks leave a trace of rounding, which would count as a day of either sign.
    ic = F.when(F.abs(ic) < 1e-13, F.lit(0.0)).otherwise(ic)
    ics = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ic.alias("ic"))
    return ics.where(F.col("_n") >= min_rows).drop("_n")


def rank_ic_by(
    df: DataFrame,
    score: str,
    target: str,
    by: str,
    segments: Sequence,
    min_rows: int = MIN_ROWS_PER_DATE,
    rows_per_bucket: int | None = BOUNDED,
) -> DataFrame:
    """Per date, the correlation within each segment, one column ``ic_<segment>`` per segment."""
    per_segment = rank_ic(
        df.where(F.col(by).isNotNull()), score, target, ["date", by], min_rows, rows_per_bucket
    )
    return per_segment.groupBy("date").agg(
        *[F.max(F.when(F.col(by) == F.lit(s), F.col("ic"))).alias(f"ic_{_name(s)}") for s in segments]
    )


def mean_ics(ics: DataFrame, by: str, horizon: int = LABEL_HORIZON) -> DataFrame:
    """Mean correlation and t-stat of each series of a (date, ``by``) table, on its own dates."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("date")) - 1
    kept = F.when(F.col("_at") % (horizon + 1) == 0, F.col("ic"))
    return (
        ics.withColumn("_at", at)
        .withColumn("_thin", kept)
        .groupBy(by)
        .agg(F.avg("ic").alias("ic"), t_stat("_thin").alias("ic_t"), F.count(F.lit(1)).alias("n_dates"))
    )


def feature_ics(
    df: DataFrame,
    features: Sequence[str],
    target: str = "forward_return",
    min_rows: int = MIN_ROWS_PER_DATE,
    rows_per_bucket: int | None = BOUNDED,
) -> DataFrame:
    """How well each feature alone ranks the target: mean per-date correlation and its t-stat.

    The features are stacked, so all of them share one ranking pass.
    """
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    stacked = df.select("date", target, F.explode(F.array(*items)).alias("_item")).select(
        "date", target, "_item.feature", "_item.value"
    )
    ics = rank_ic(
        stacked.where(F.col("value").isNotNull()), "value", target, ["date", "feature"], min_rows, rows_per_bucket
    )
    return mean_ics(ics, "feature")


def ranking_frame(predictions: DataFrame, rows_per_bucket: int | None = BOUNDED) -> DataFrame:
    """What the ranking metrics need per test row: score, returns and segments."""
    scored = predictions.withColumns(
        {
            "score": F.col("p_up") - F.col("p_down"),
            "simple_return": F.expm1("forward_return"),
            "_traded": F.col("close") * F.col("volume"),
        }
    )
    ranked = with_average_ranks(
        scored,
        ["date"],
        {"_volatility": "volatility_21d", "_liquidity": "_traded"},
        pct=True,
        rows_per_bucket=rows_per_bucket,
    )
    columns = [
        "symbol",
        "date",
        "score",
        "forward_return",
        "simple_return",
        quantile_bucket("_volatility", 3).alias("volatility_tercile"),
        quantile_bucket("_liquidity", 5).alias("liquidity_quintile"),
    ]
    if "news_count_7d" in predictions.columns:
        columns.append((F.col("news_count_7d") > 0).alias("has_news"))
    return ranked.select(*columns)


def segment_ics(
    frame: DataFrame, min_rows: int = MIN_ROWS_PER_DATE, rows_per_bucket: int | None = BOUNDED
) -> DataFrame:
    """Per date, the correlation overall and in every segment, from one ranking pass."""
    kinds = [F.struct(F.lit("all").alias("kind"), F.lit(0).cast("bigint").alias("segment"))]
    kinds.append(F.struct(F.lit("volatility").alias("kind"), F.col("volatility_tercile").alias("segment")))
    kinds.append(F.struct(F.lit("liquidity").alias("kind"), F.col("liquidity_quintile").alias("segment")))
    if "has_news" in frame.columns:
        kinds.append(F.struct(F.lit("news").alias("kind"), F.col("has_news").cast("bigint").alias("segment")))
    stacked = frame.select(
        "date", "score", "forward_return", F.explode(F.array(*kinds)).alias("_k")
    ).select("date", "score", "forward_return", "_k.kind", "_k.segment")
    ics = rank_ic(
        stacked.where(F.col("segment").isNotNull()),
        "score",
        "forward_return",
        ["date", "kind", "segment"],
        min_rows,
        rows_per_bucket,
    )

    def of(kind: str, segment: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("segment") == segment), F.col("ic")))

    def present(kind: str, segment: int | None = None) -> Column:
        match = F.col("kind") == kind
        if segment is not None:
            match = match & (F.col("segment") == segment)
        return F.max(match.cast("int")) == 1

    columns = [
        of("all", 0).alias("ic"),
        present("all").alias("_in_ic"),
        F.avg(F.when(F.col("kind") == "volatility", F.col("ic"))).alias("volatility_neutral_ic"),
        present("volatility").alias("_in_volatility_neutral_ic"),
    ]
    columns += [of("volatility", i).alias(f"ic_volatility_{i}") for i in TERCILES]
    columns += [of("liquidity", i).alias(f"ic_liquidity_{i}") for i in QUINTILES]
    if "has_news" in frame.columns:
        columns += [of("news", 1).alias("ic_news"), of("news", 0).alias("ic_no_news")]
    return ics.groupBy("date").agg(*columns)


def decile_returns(frame: DataFrame, rows_per_bucket: int | None = BOUNDED) -> DataFrame:
    """Per date: mean simple return of the top and bottom score decile, and of all rows."""
    ranked = with_pct_rank(frame, ["date"], "score", "_pct", rows_per_bucket=rows_per_bucket)
    pct = F.col("_pct")
    daily = ranked.groupBy("date").agg(
        F.avg(F.when(pct > 0.9, F.col("simple_return"))).alias("top"),
        F.avg(F.when(pct <= 0.1, F.col("simple_return"))).alias("bottom"),
        F.avg("simple_return").alias("mean"),
    )
    return daily.withColumn("spread", F.col("top") - F.col("bottom"))


def ranking_metrics(
    frame: DataFrame, min_rows: int = MIN_ROWS_PER_DATE, rows_per_bucket: int | None = BOUNDED
) -> tuple[DataFrame, DataFrame]:
    """The one-row summary, and the per-date series used to compare models.

    The per-date table is bounded by the calendar.
    """
    ics = segment_ics(frame, min_rows, rows_per_bucket)
    deciles = decile_returns(frame, rows_per_bucket).withColumn(
        "_in_spread", F.col("top").isNotNull() | F.col("bottom").isNotNull()
    )
    per_date = deciles.join(ics, "date", "left").withColumns(
        {
            c: F.coalesce(c, F.lit(False))
            for c in ("_in_ic", "_in_volatility_neutral_ic")
        }
    )
    means = [
        F.avg("ic").alias("ic"),
        F.avg(F.when(F.col("_in_ic"), F.coalesce(F.col("ic") > 0, F.lit(False)).cast("double"))).alias(
            "ic_positive_days"
        ),
        F.avg("volatility_neutral_ic").alias("volatility_neutral_ic"),
        *[F.avg(f"ic_volatility_{i}").alias(f"ic_volatility_{i}") for i in TERCILES],
        *[F.avg(f"ic_liquidity_{i}").alias(f"ic_liquidity_{i}") for i in QUINTILES],
        (F.avg("top") * 1e4).alias("top_decile_bps"),
        (F.avg("bottom") * 1e4).alias("bottom_decile_bps"),
        (F.avg("spread") * 1e4).alias("spread_bps"),
        (F.avg(F.col("top") - F.col("mean")) * 1e4).alias("top_minus_mean_bps"),
    ]
    series = ["ic", "volatility_neutral_ic", "ic_liquidity_5"]
    if "has_news" in frame.columns:
        means += [F.avg("ic_news").alias("ic_news"), F.avg("ic_no_news").alias("ic_no_news")]
        series.append("ic_news")
    t_columns = ["ic", "volatility_neutral_ic", "spread"]
    t_row = single_row(t_stats(per_date, t_columns))
    summary = per_date.agg(*means).withColumns({f"{c}_t": t_row[f"{c}_t"] for c in t_columns})
    daily = per_date.select(
        "date",
        *[F.col(c).alias({"ic_liquidity_5": "most_liquid_ic", "ic_news": "news_ic"}.get(c, c)) for c in series],
        (F.col("spread") * 1e4).alias("spread_bps"),
    )
    return summary, daily


def calibration_error(
    predictions: DataFrame, n_bins: int = 10, rows_per_bucket: int | None = ROWS_PER_BUCKET
) -> DataFrame:
    """Expected calibration error per class over quantile bins, one row per class.

    A class holds every row of the table, so its quantiles are found by counting, not by ordering.
    """
    y = label_index("label")
    stacked = predictions.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rating"),
                        F.col(p).cast("double").alias("p"),
                        (y == i).cast("double").alias("hit"),
                    )
                    for i, (name, p) in enumerate(zip(RATINGS, PROBABILITIES))
                ]
            )
        ).alias("_item")
    ).select("_item.*")
    fractions = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    edges = group_quantiles(stacked, ["rating"], "p", fractions, rows_per_bucket).select(
        "rating", F.array_distinct("quantiles").alias("_edges")
    )
    # One row per class.
    binned = stacked.join(F.broadcast(edges), "rating").withColumn(
        "bin", F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("p"))), F.lit(1))
    )
    bins = binned.groupBy("rating", "bin").agg(
        F.avg("p").alias("predicted"), F.avg("hit").alias("observed"), F.count(F.lit(1)).alias("n")
    )
    gap = F.abs(F.col("predicted") - F.col("observed")) * F.col("n")
    return bins.groupBy("rating").agg((F.sum(gap) / F.sum("n")).alias("ece"))


# Baselines and classification scores.


def resolved_label_lag(df: DataFrame, rows_per_bucket: int | None = BOUNDED) -> DataFrame:
    """Add ``lagged_label``: the symbol's latest label whose window closed by the row's date.

    A daily table; one of finer grain names ``rows_per_bucket``.
    """
    return asof_join(
        df, df, "date", "label_end_date", ["symbol"], {"lagged_label": "label"}, rows_per_bucket=rows_per_bucket
    )


def trailing_return_label() -> Column:
    return rating_of("trailing_return", "threshold")


def class_prior(train: DataFrame) -> DataFrame:
    """One row: the share of each class in the training labels."""
    y = label_index("label")
    return train.where(y.isNotNull()).agg(
        *[F.avg((y == i).cast("double")).alias(f"prior_{name.lower()}") for i, name in enumerate(RATINGS)]
    )


def majority_class(train: DataFrame) -> DataFrame:
    """One row: the most frequent class, the smallest on ties."""
    counts = train.select(label_index("label").alias("y")).where(F.col("y").isNotNull()).groupBy("y").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("majority"))


def confusion_counts(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (label ``y``, prediction ``pred``), at most nine rows per key."""
    return pairs.groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def f1_scores(confusion: DataFrame, keys: Sequence[str] = (), all_classes: bool = False) -> DataFrame:
    """Per key: the F1 of each class and their mean.

    The mean is over the classes that occur, or over all three with ``all_classes``. A class
    without hits scores 0.
    """
    keys = list(keys)
    aggregates = []
    for i, name in enumerate(RATINGS):
        hit = F.sum(F.when((F.col("y") == i) & (F.col("pred") == i), F.col("n")).otherwise(0))
        touched = F.sum(
            F.when(F.col("y") == i, F.col("n")).otherwise(0)
            + F.when(F.col("pred") == i, F.col("n")).otherwise(0)
        )
        aggregates += [hit.alias(f"_hit_{i}"), touched.alias(f"_touched_{i}")]
    sums = confusion.groupBy(*keys).agg(*aggregates)
    f1 = [
        F.coalesce(F.try_divide(2.0 * F.col(f"_hit_{i}"), F.col(f"_touched_{i}")), F.lit(0.0))
        for i in range(len(RATINGS))
    ]
    occurs = [(F.col(f"_touched_{i}") > 0).cast("int") for i in range(len(RATINGS))]
    classes = F.lit(len(RATINGS)) if all_classes else occurs[0] + occurs[1] + occurs[2]
    return sums.select(
        *keys,
        F.try_divide(f1[0] + f1[1] + f1[2], classes).alias("macro_f1"),
        *[f1[i].alias(f"{name.lower()}_f1") for i, name in enumerate(RATINGS)],
    )


def log_loss(y: Column, probabilities: Sequence, epsilon: float = EPSILON) -> Column:
    """Mean negative log probability of the true class, an aggregate."""
    p = F.element_at(F.array(*[_as_column(q) for q in probabilities]), (y + 1).cast("int"))
    clipped = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return -F.avg(F.log(clipped))


def evaluate_model(
    predictions: DataFrame, train: DataFrame, class_scale: Sequence[float] | None = None
) -> DataFrame:
    """One row per model: F1 scores and log loss of the model and of the naive baselines.

    All are scored on the rows that have a resolved earlier label.
    """
    rows = (
        resolved_label_lag(predictions)
        .where(F.col("lagged_label").isNotNull())
        .withColumn("y", label_index("label"))
    )
    prior = single_row(class_prior(train))
    predicted = {
        "model": argmax_class(*PROBABILITIES),
        "majority_class": majority_class(train).scalar(),
        "persistence": label_index("lagged_label"),
        "trailing_return": label_index(trailing_return_label()),
    }
    if class_scale is not None:
        predicted["model_scaled"] = argmax_class(
            *[F.col(p) * F.lit(float(s)) for p, s in zip(PROBABILITIES, class_scale)]
        )
    pairs = rows.select(
        "y",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in predicted.items()])
        ).alias("_item"),
    ).select("y", "_item.*")
    scores = f1_scores(confusion_counts(pairs, ["model"]), ["model"])
    priors = [prior[f"prior_{name.lower()}"] for name in RATINGS]
    losses = rows.agg(
        log_loss(F.col("y"), PROBABILITIES).alias("model"),
        log_loss(F.col("y"), priors).alias("class_prior"),
    )
    losses = losses.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.col(m).alias("log_loss"))
                    for m in ("model", "class_prior")
                ]
            )
        ).alias("_item")
    ).select("_item.*")
    return scores.join(losses, "model", "full_outer")


def seed_average(runs: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Mean probabilities over the seeds of each row."""
    return runs.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in PROBABILITIES])


def mean_and_spread(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of run metrics per experiment."""
    return metrics.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )


def compare_to_baseline(
    daily: DataFrame, baseline: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """One row: mean per-date difference to the baseline and its t-stat, per column."""
    base = baseline.select("date", *[F.col(c).alias(f"_base_{c}") for c in columns])
    both = daily.join(base, "date", "full_outer").select(
        "date", *[(F.col(c) - F.col(f"_base_{c}")).alias(f"delta_{c}") for c in columns]
    )
    thinned = independent_dates(both)
    t_row = single_row(thinned.agg(*[t_stat(f"delta_{c}").alias(f"delta_{c}_t") for c in columns]))
    means = both.agg(*[F.avg(f"delta_{c}").alias(f"delta_{c}") for c in columns])
    return means.withColumns({f"delta_{c}_t": t_row[f"delta_{c}_t"] for c in columns})


def _as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _name(segment) -> str:
    return str(segment).lower()
