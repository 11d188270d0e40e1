"""Feature-set experiments: the splits, the placebo, resumable runs, and their comparison."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.scalars import suffix_columns, zero_fill
from quotemill.operators.buckets import BOUNDED, hashed_positions
from quotemill.operators.joins import join_null_safe, left_join_one_to_one
from quotemill.plans.evaluation import (
    PROBABILITIES,
    calibration_error,
    compare_to_baseline,
    evaluate_model,
    mean_and_spread,
    ranking_frame,
    ranking_metrics,
    seed_average,
)
from quotemill.plans.modeling import Params, assert_feature_set, fit_boosted, fit_forest, score_predictions
from quotemill.plans.splits import chronological_split, split_date_ranges
from quotemill.schemas import (
    COUNT_FEATURES,
    EVALUATION_COLUMNS,
    HEADLINE_FEATURES,
    MIN_ROWS_PER_DATE,
    PRICE_FEATURES,
    RATINGS,
    SUMMARY_FEATURES,
)
from quotemill.sources.tables import is_built

SAME_DAY_SUFFIX = "_same_day"
# Seeds of every experiment.
SEEDS = [0, 1, 2]


@dataclass(frozen=True)
class Experiment:
    name: str
    description: str
    features: tuple[str, ...]
    same_day: bool = False
    shuffle_news: bool = False


# The experiments and the features each may use.
EXPERIMENTS = [
    Experiment("A", "prices only", tuple(PRICE_FEATURES)),
    Experiment("B", "prices and headlines", tuple(PRICE_FEATURES + HEADLINE_FEATURES)),
    Experiment(
        "C", "prices, headlines and summaries", tuple(PRICE_FEATURES + HEADLINE_FEATURES + SUMMARY_FEATURES)
    ),
    Experiment(
        "B_placebo", "B with headlines moved between symbols",
        tuple(PRICE_FEATURES + HEADLINE_FEATURES), shuffle_news=True,
    ),
    Experiment(
        "B_same_day", "B with news of the same day",
        tuple(PRICE_FEATURES + HEADLINE_FEATURES), same_day=True,
    ),
]


def load_experiment_splits(fused: DataFrame, same_day: DataFrame, validate: bool = True) -> DataFrame:
    """The fused dataset with the same-day headline features next to it, and its split."""
    features = PRICE_FEATURES + HEADLINE_FEATURES + SUMMARY_FEATURES
    assert_feature_set(fused, features)
    fresher = suffix_columns(
        same_day.select("symbol", "date", *HEADLINE_FEATURES), HEADLINE_FEATURES, SAME_DAY_SUFFIX
    )
    joined = left_join_one_to_one(
        fused.select(*EVALUATION_COLUMNS, *features), fresher, ["symbol", "date"], validate
    )
    return chronological_split(zero_fill(joined, [f"{c}{SAME_DAY_SUFFIX}" for c in COUNT_FEATURES]))


def shuffle_within_date(
    df: DataFrame, columns: Sequence[str], seed: int, key: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Move a block of columns between the rows of the same date, as a seeded permutation.

    Rows are numbered twice in their date, by two seeded hashes of the key, and the block travels
    from the row of a number in one order to the row of the same number in the other. A date has one
    row per symbol. Rows without a date are a group of their own.
    """
    columns, key = list(columns), list(key)
    takers = hashed_positions(df.drop(*columns), ["date"], key, seed, "_place", BOUNDED)
    givers = hashed_positions(df.select("date", *key, *columns), ["date"], key, seed + 7919, "_place", BOUNDED)
    moved = join_null_safe(takers, givers.select("date", "_place", *columns), ["date", "_place"])
    return moved.drop("_place").select(*df.columns)


def experiment_features(df: DataFrame, experiment: Experiment, seed: int) -> DataFrame:
    """A split with the experiment's features under their base names, as float."""
    headline = set(HEADLINE_FEATURES)

    def source(c: str) -> str:
        return f"{c}{SAME_DAY_SUFFIX}" if experiment.same_day and c in headline else c

    others = [c for c in EVALUATION_COLUMNS if c not in experiment.features]
    extra = [c for c in ("news_count_7d", "volatility_21d") if c not in experiment.features and c in df.columns]
    out = df.select(
        *others, *extra, *[F.col(source(c)).cast("float").alias(c) for c in experiment.features]
    )
    if experiment.shuffle_news:
        out = shuffle_within_date(out, HEADLINE_FEATURES, seed)
    return out


def run_config(experiment: Experiment, seed: int, params: Params, ranges: Sequence, boosted: bool = False) -> str:
    """Everything a run's result depends on, as canonical JSON."""
    config = {**asdict(experiment), "seed": seed, "params": params, "splits": sorted(ranges)}
    return json.dumps(config | ({"boosted": True} if boosted else {}), sort_keys=True)


def config_key(config: str) -> str:
    """Short name of a configuration; runs and probabilities are stored under it."""
    return hashlib.sha256(config.encode()).hexdigest()[:16]


def saved_runs(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/runs") if is_built(spark, f"{path}/runs") else None


def run_experiment(
    spark: SparkSession,
    experiment: Experiment,
    seed: int,
    splits: DataFrame,
    params: Params,
    path: str,
    boosted: bool = False,
) -> bool:
    """Train one experiment with one seed and save its test probabilities and scores.

    A ``boosted`` model stops early on the validation part; a forest is only scored on it.

    Skipped, returning False, if a run with the same configuration is already saved. Every configuration has
    probabilities of its own, and its scores are written last, so a run that broke off is done again and no
    run changes another's. ``splits`` should be a stored table.
    """
    config = run_config(experiment, seed, params, _ranges(splits), boosted)
    key = config_key(config)
    runs = saved_runs(spark, path)
    if runs is not None and runs.where(F.col("config_key") == key).head(1):
        return False
    part = lambda name: splits.where(F.col("split") == name).drop("split")
    # The seeds of the permutations are far apart, so no part repeats another's.
    train = experiment_features(part("train"), experiment, seed)
    val = experiment_features(part("val"), experiment, seed + 1000)
    test = experiment_features(part("test"), experiment, seed + 2000)
    if boosted:
        model = fit_boosted(train, val, experiment.features, params, seed)
    else:
        model = fit_forest(train, experiment.features, params, seed)
    val_loss = score_predictions(model.predict(val)).select("log_loss")
    predicted = model.predict(test)
    kept = [*EVALUATION_COLUMNS, "volatility_21d", "news_count_7d", *PROBABILITIES]
    probabilities = f"{path}/probabilities/experiment={experiment.name}/seed={seed}/config_key={key}"
    predicted.select(*[c for c in kept if c in predicted.columns]).write.mode("overwrite").parquet(probabilities)
    stored = spark.read.parquet(probabilities)
    scores = evaluate_model(stored, train).where(F.col("model") == "model")
    classes = {name: f"ece_{name.lower()}" for name in RATINGS}
    ece = calibration_error(stored).agg(
        F.struct(F.avg("ece").alias("mean_ece"), *[F.max(F.when(F.col("rating") == r, F.col("ece"))).alias(c) for r, c in classes.items()]).alias("e")
    )
    ece = ece.scalar()
    row = scores.select(
        F.lit(experiment.name).alias("experiment"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.lit(config).alias("config"),
        F.lit(key).alias("config_key"),
        F.col("macro_f1"),
        F.col("log_loss"),
        *[ece[c].alias(c) for c in ("mean_ece", *classes.values())],
        val_loss.scalar().alias("val_log_loss"),
        F.lit(model.best_round if boosted else None).cast("bigint").alias("best_iteration"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return True


def _ranges(splits: DataFrame) -> list[tuple]:
    return [tuple(r) for r in split_date_ranges(splits).collect()]


def summarize(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    min_rows: int = MIN_ROWS_PER_DATE,
    baseline: str = "A",
    rows_per_bucket: int | None = BOUNDED,
    configs: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Tables ``per_seed``, ``seed_averaged`` and ``differences`` of the saved runs.

    ``configs`` are the keys of the wanted configurations (:func:`config_key`). Without them there may be only
    one per experiment and seed.
    """
    runs = saved_runs(spark, path).where(F.col("experiment").isin(list(names)))
    probabilities = spark.read.option("basePath", f"{path}/probabilities").parquet(
        *[f"{path}/probabilities/experiment={n}" for n in names]
    )
    if configs is None:
        several = runs.groupBy("experiment", "seed").agg(F.count_distinct("config_key").alias("n")).where("n > 1")
        if several.head(1):
            raise ValueError("runs of several configurations are saved; name the wanted ones")
    else:
        runs = runs.where(F.col("config_key").isin(list(configs)))
    # Only probabilities of finished runs count.
    wanted = runs.select("experiment", "seed", "config_key").distinct()
    probabilities = probabilities.withColumn("seed", F.col("seed").cast("bigint"))
    probabilities = probabilities.join(wanted, ["experiment", "seed", "config_key"], "left_semi").drop("config_key")
    scores = ["macro_f1", "log_loss", "mean_ece", *[f"ece_{r.lower()}" for r in RATINGS], "val_log_loss", "best_iteration"]
    seeds = runs.groupBy("experiment").agg(F.count_distinct("seed").alias("n_seeds"))
    per_seed = mean_and_spread(runs, ["experiment"], scores).join(seeds, "experiment")
    summaries, daily = [], {}
    for name in names:
        one = probabilities.where(F.col("experiment") == name)
        averaged = seed_average(one)
        first_seed = one.agg(F.min("seed").alias("seed")).scalar()
        rows = one.where(F.col("seed") == first_seed).drop(*PROBABILITIES, "experiment", "seed")
        frame = ranking_frame(rows.join(averaged, ["symbol", "date"]), rows_per_bucket)
        summary, daily[name] = ranking_metrics(frame, min_rows, rows_per_bucket)
        summaries.append(summary.withColumn("experiment", F.lit(name)))
    table = summaries[0]
    for summary in summaries[1:]:
        table = table.unionByName(summary, allowMissingColumns=True)
    differences = None
    for name in names:
        if baseline in daily and name != baseline:
            columns = [c for c in daily[name].columns if c != "date" and c in daily[baseline].columns]
            row = compare_to_baseline(daily[name], daily[baseline], columns).withColumn(
                "experiment", F.lit(name)
            )
            differences = row if differences is None else differences.unionByName(row, allowMissingColumns=True)
    out = {"per_seed": per_seed, "seed_averaged": table}
    if differences is not None:
        out["differences"] = differences
    return out


def run_experiments(
    spark: SparkSession,
    splits: DataFrame,
    params: Params,
    path: str,
    experiments: Sequence[Experiment] = tuple(EXPERIMENTS),
    seeds: Sequence[int] = tuple(SEEDS),
    min_rows: int = MIN_ROWS_PER_DATE,
    boosted: bool = False,
) -> dict[str, DataFrame]:
    """Run what is missing, then compare all experiments."""
    ranges, configs = _ranges(splits), []
    for experiment in experiments:
        for seed in seeds:
            run_experiment(spark, experiment, seed, splits, params, path, boosted)
            configs.append(config_key(run_config(experiment, seed, params, ranges, boosted)))
    return summarize(spark, path, [e.name for e in experiments], min_rows, configs=configs)
